"""The SQL of the question queries: the patterns and aliases are written out here, apart from the library's."""

# Kind, order, name, days and pattern of each refusal, intent and time window.
PATTERNS = r"""
(VALUES
 ('refusal', 0, 'sales volume', 0, '\b(units (?:sold|moved)|sales volume|sales figures|how many (?:units )?(?:were )?(?:sold|sell per)|revenue for|turnover for|conversion rate|sells? (?:the )?best|best[- ]?sell(?:er|ing)|top[- ]?sell(?:er|ing)|what(?:''s| is) selling|moves? (?:the )?(?:most|fastest)|fastest[- ]?moving)\b'),
 ('refusal', 1, 'forecast', 0, '\b(will|should) (?:i|we) (?:make|profit|succeed|do well)|is it a good (?:idea|business)|guarantee\w*\b'),
 ('refusal', 2, 'competitor cost', 0, '\b(competitor|rival)(?:''s)? (?:cost|margin|supplier|source)|who supplies|where do they (?:buy|source)\b'),
 ('intent', 0, 'cost_of_business', 0, '\b(cost of (?:doing )?business|total cost|cost to sell|cheaper to sell|where should i sell|which platform (?:is )?(?:cheaper|better|costs)|what does it cost me|all the fees|total fees|take rate|jumia (?:or|vs\.?|versus) kilimall)\b'),
 ('intent', 1, 'payout', 0, '\b(when (?:do|will) i get paid|payout|pay ?out|payment (?:cycle|terms)|how (?:long|soon) (?:until|before|do) i (?:get|receive)|cash cycle|settlement)\b'),
 ('intent', 2, 'returns', 0, '\b(returns? policy|return window|who pays for (?:the )?return|can (?:a )?(?:buyer|customer) return|refund policy)\b'),
 ('intent', 3, 'activity', 0, '\b(most searched|most popular|what(?:''s| is) (?:hot|trending|busy|popular)|busiest|most (?:listed|active)|what are people (?:buying|selling)|top categor|biggest categor|most competitive categor|where are (?:the )?sellers)\b'),
 ('intent', 4, 'opportunity', 0, '\b(where(?:''s| is| are)?(?: there)?(?: (?:a|the|any))? (?:room|gap|gaps|opportunit\w*|space)|(?:room|gap|opportunit\w*|space) (?:in|for) the market|least (?:crowded|saturated)|less (?:crowded|saturated)|what should i sell|which categor(?:y|ies) should i|best categor(?:y|ies) to (?:enter|start|sell)|easiest to enter|underserved|not saturated)\b'),
 ('intent', 5, 'margin', 0, '\b(margin|profit|markup|mark up|worth (?:it|selling)|make money|landed cost|how much (?:can|will) i (?:make|earn))\b'),
 ('intent', 6, 'trend', 0, '\b(trend|trending|over time|since|last (?:month|quarter|year|\d+ days)|going up|going down|rising|falling|history|historical|has the price|have prices)\b'),
 ('intent', 7, 'saturation', 0, '\b(saturat\w*|crowded|competitive|competition|too many sellers|oversupplied)\b'),
 ('intent', 8, 'compare', 0, '\b(compare|comparison|versus|vs\.?|which platform|best platform|jumia or kilimall|across platforms|platform to)\b'),
 ('intent', 9, 'seller_count', 0, '\b(how many (?:sellers|vendors|shops|listings)|number of (?:sellers|listings)|seller count|who else sells)\b'),
 ('intent', 10, 'commission', 0, '\b(commission|fee|fees|cut|percentage|what does jumia take|charge me|take from)\b'),
 ('intent', 11, 'coverage', 0, '\b(deliver to|delivery to|ship to|shipping to|collection point|coverage|available in|do (?:you|they) cover|pickup station)\b'),
 ('intent', 12, 'policy', 0, '\b(onboard\w*|sign up|register|requirements?|documents?|terms|how do i (?:start|become)|kyc|payout|pay on delivery|cash on delivery)\b'),
 ('intent', 13, 'price_level', 0, '\b(price|cost|sell for|selling for|going for|how much|median|average|typical|charge for|worth)\b'),
 ('window', 0, 'fixed', 1, '\blast (\d+)\s*days?\b'),
 ('window', 1, 'fixed', 7, '\blast (\d+)\s*weeks?\b'),
 ('window', 2, 'fixed', 30, '\blast (\d+)\s*months?\b'),
 ('window', 3, 'fixed', 90, '\blast quarter\b'),
 ('window', 4, 'fixed', 30, '\blast month\b'),
 ('window', 5, 'fixed', 7, '\blast week\b'),
 ('window', 6, 'fixed', 365, '\blast year\b'),
 ('window', 7, 'fixed', 90, '\bsince (?:june|jun)\b')
) p(kind, place, name, days, pattern)
"""

# The longest alias first, then the vocabulary's order; the last word may be in the plural.
ALIASES = r"""
(VALUES
 ('category', 0, 'bolts', 'steel bolt(s|es)?'), ('category', 1, 'gears', 'the gear(s|es)?'), ('category', 2, 'data', 'table(s|es)?'), ('category', 3, 'bolts', 'bolt(s|es)?'),
 ('category', 4, 'gears', 'gear(s|es)?'), ('category', 5, 'data', 'data(s|es)?'), ('category', 6, 'data', 'text(s|es)?'),
 ('platform', 0, 'O', 'open market(s|es)?'), ('platform', 1, 'F', 'fixed house(s|es)?'), ('platform', 2, 'O', 'example(s|es)?'), ('platform', 3, 'F', 'page(s|es)?'),
 ('county', 0, 'n1', 'france(s|es)?'), ('county', 1, 'n2', 'berlin(s|es)?'), ('county', 2, 'n1', 'paris(s|es)?'), ('county', 3, 'n2', 'cit(y|ies)')
) a(kind, place, code, pattern)
"""

ROUTED = f"""
WITH q AS (SELECT row_number() OVER () AS r, conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations WHERE role = 'user'),
hits AS (SELECT r, kind, place, name, days, regexp_extract(t, '(?i)' || pattern, 0) AS hit, CASE WHEN name = 'counted' THEN regexp_extract(t, '(?i)' || pattern, 1) END AS n FROM q, {PATTERNS} WHERE regexp_matches(t, '(?i)' || pattern)),
found AS (SELECT r, kind, arg_min(name, place) AS name, arg_min(hit, place) AS hit, arg_min(CASE WHEN name = 'counted' THEN coalesce(TRY_CAST(n AS INTEGER) * days, -1) ELSE days END, place) AS days FROM hits GROUP BY r, kind),
named AS (SELECT r, kind, arg_min(code, place) AS code FROM q, {ALIASES} WHERE regexp_matches(lower(t), '\\b' || pattern || '\\b') GROUP BY r, kind),
i AS (SELECT q.*, f.name AS refused, g.name AS found, coalesce(f.hit, g.hit) AS matched_on, nullif(w.days, -1) AS days, c.code AS cat, p.code AS plat, y.code AS county FROM q
 LEFT JOIN found f ON f.r = q.r AND f.kind = 'refusal' LEFT JOIN found g ON g.r = q.r AND g.kind = 'intent' LEFT JOIN found w ON w.r = q.r AND w.kind = 'window'
 LEFT JOIN named c ON c.r = q.r AND c.kind = 'category' LEFT JOIN named p ON p.r = q.r AND p.kind = 'platform' LEFT JOIN named y ON y.r = q.r AND y.kind = 'county'),
r AS (SELECT *, t = '' OR refused IS NOT NULL AS blank FROM i),
routed AS (SELECT conv_id, turn, CASE WHEN refused IS NULL THEN coalesce(found, 'unknown') ELSE 'unknown' END AS intent,
  CASE WHEN t = '' THEN 'empty' WHEN refused IS NOT NULL THEN refused WHEN found IS NULL THEN 'not understood' END AS refusal, matched_on,
  CASE WHEN NOT blank THEN days END AS window_days, CASE WHEN NOT blank THEN cat END AS category_code, CASE WHEN NOT blank THEN plat END AS platform_code, CASE WHEN NOT blank THEN county END AS county_code FROM r)
"""
