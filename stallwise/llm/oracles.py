"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

OP3 = rf"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s GROUP BY source),
b AS (SELECT *, [5, 2, 1][1 + (sid - 1) % 3] AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM a),
c AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM b),
d AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM c),
e AS (SELECT *, first(CASE WHEN lvl <= ratio THEN lvl END IGNORE NULLS) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM d),
f AS (SELECT *, least(2.0::DOUBLE * source_size, lv * weight) AS target FROM e),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal, least(greatest(256, CAST(ceil(target / 512) AS BIGINT)), greatest(CAST(floor(target) AS BIGINT), 1)) AS pieces FROM f),
h AS (SELECT *, greatest(CAST(ceil(goal::DOUBLE / pieces) AS BIGINT), 1) AS block FROM g),
k AS (SELECT *, CAST(ceil(goal::DOUBLE / block) AS BIGINT) AS blocks FROM h),
m AS (SELECT *, coalesce(CAST(sum(blocks) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos, CAST(sum(blocks) OVER () AS BIGINT) AS allb FROM k),
src AS (SELECT *, CAST(floor(pos::DOUBLE / greatest(allb, 1) * 2147483648) AS BIGINT) AS lo, CAST(floor((pos + blocks)::DOUBLE / greatest(allb, 1) * 2147483648) AS BIGINT) AS hi FROM m),
pts AS (SELECT j, j % 2147483648 * 1327217885 % 2147483648 AS u FROM (SELECT unnest(range(0, (SELECT CASE WHEN max(allb) > 0 THEN CAST(floor(max(allb) * 1.05::DOUBLE) AS BIGINT) + 64 ELSE 0 END FROM src))) AS j)),
slots AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY j) - 1 AS rank, blocks FROM pts JOIN src ON u >= lo AND u < hi),
used AS (SELECT sid, rank FROM slots WHERE rank < blocks UNION ALL
      SELECT sid, unnest(range(coalesce(n, 0), blocks)) FROM src LEFT JOIN (SELECT sid, count(*) AS n FROM slots GROUP BY 1) USING (sid)),
o AS (SELECT s.doc_id, s.size, src.*, coalesce(CAST(sum(size) OVER (PARTITION BY sid ORDER BY md5(concat('mix:', s.doc_id)), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS st,
      row_number() OVER () AS r FROM s JOIN src ON s.source IS NOT DISTINCT FROM src.source),
p AS (SELECT o.*, again, source_size * again + st AS x, least(source_size * again + st + size, goal) AS y FROM o, (VALUES (0), (1)) v(again)),
q AS (SELECT r, sid, block, x, y, unnest(range(x // block, (y - 1) // block + 1)) AS kk FROM p WHERE x < y),
t AS (SELECT q.r, sum(least(y, (kk + 1) * block) - greatest(x, kk * block)) AS words FROM q JOIN used ON used.sid = q.sid AND used.rank = q.kk GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(CAST(words AS BIGINT), 0) AS taken FROM o LEFT JOIN t USING (r)
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM g),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.component_id FROM g JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
"""


def op9(rules: list[tuple[str, str]], min_support: int = 5, depth: int = 4, strength: float = 4.0, threshold: float = 0.5) -> str:
    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash + path}')"

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    pick = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in ordered) + " END"
    levels, last = [], "l0"
    for d in range(1, depth + 1):
        levels.append(
            f"s{d} AS (SELECT *, CASE WHEN segs[{d}] IS NULL OR sum(n) OVER (PARTITION BY host, template, segs[{d}]) >= {min_support} THEN segs[{d}] ELSE '*' END AS seg FROM {last}),\n"
            f"l{d} AS (SELECT host, shape, n, blocked, labelled, segs, CASE WHEN seg IS NULL THEN parent ELSE template END AS parent, template || coalesce('/' || seg, '') AS template FROM s{d}),"
        )
        last = f"l{d}"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
r AS (SELECT *, {pick(1)} AS rule, {pick(0)} AS decision, regexp_replace(path, '[0-9]+', '0', 'g') AS shape FROM c),
l0 AS (SELECT host, shape, count(*) AS n, count_if(decision = 'block') AS blocked, count(decision) AS labelled, list_filter(string_split(shape, '/'), lambda s: s <> '') AS segs, '' AS parent, '' AS template FROM r GROUP BY host, shape),
{chr(10).join(levels)}
tree AS (SELECT host, shape, blocked, labelled, CASE WHEN len(segs) > {depth} THEN template ELSE parent END AS parent, CASE WHEN len(segs) > {depth} THEN template || '/**' ELSE template END AS template FROM {last}),
nodes AS (SELECT host, parent, template, CAST(sum(blocked) AS BIGINT) AS blocked, CAST(sum(labelled) AS BIGINT) AS labelled FROM tree GROUP BY ALL),
e AS (SELECT *, blocked::DOUBLE / labelled AS share FROM nodes WHERE labelled > 0),
f AS (SELECT *, lag(blocked) OVER w AS b0, lag(labelled) OVER w AS n0 FROM e WINDOW w AS (PARTITION BY host, parent ORDER BY share, template)),
g AS (SELECT *, (blocked + b0)::DOUBLE / (labelled + n0) AS pooled FROM f),
h AS (SELECT *, CASE WHEN (share - b0::DOUBLE / n0) * (share - b0::DOUBLE / n0) > 1.96 * 1.96 * (pooled * (1 - pooled) * (1.0 / labelled + 1.0 / n0)) THEN 1 ELSE 0 END AS differs FROM g),
i AS (SELECT *, sum(differs) OVER (PARTITION BY host, parent ORDER BY share, template ROWS UNBOUNDED PRECEDING) AS branch FROM h),
j AS (SELECT host, template, sum(blocked) OVER (PARTITION BY host, parent, branch) AS bb, sum(labelled) OVER (PARTITION BY host, parent, branch) AS bn FROM i),
o AS (SELECT (sum(blocked) + 1)::DOUBLE / (sum(labelled) + 2) AS p FROM nodes),
k AS (SELECT template, (sum(blocked) + {strength} * any_value(o.p))::DOUBLE / (sum(labelled) + {strength}) AS prior FROM nodes, o GROUP BY template),
m AS (SELECT t.host, t.shape, (coalesce(bb, 0) + {strength} * prior) / (coalesce(bn, 0) + {strength}) AS purity FROM tree t JOIN k USING (template) LEFT JOIN j ON j.host = t.host AND j.template = t.template)
SELECT page_id, r.host, path, rule, coalesce(decision, CASE WHEN purity >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN m ON m.host = r.host AND m.shape = r.shape
"""


def _chars(inside: str) -> str:
    return f"length(regexp_replace(t, '[^{inside}]', '', 'g'))"


_P_LOG = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines,
      {_chars('#*$%&|<>')} AS n_symbols, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars FROM d),
k AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS key FROM w),
dup AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, key) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY r),
base AS (SELECT w.r, len(ws) AS n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
c AS (SELECT r, lang, length(t) AS n, [{_chars(chr(92) + 'p{Ll}')}, {_chars(chr(92) + 'p{Lu}')}, {_chars(chr(92) + 'p{Nd}')}, {_chars(chr(92) + 'p{Zs}' + chr(92) + 'x09-' + chr(92) + 'x0D')},
      {_chars(chr(92) + 'p{Po}' + chr(92) + 'p{Pd}')} - {_chars('#%&*!@' + chr(92) * 2)}, {_chars('#*$%&|<>!@' + chr(92) * 2 + chr(92) + '^~=+_')}] AS six FROM d),
c7 AS (SELECT r, lang, n, list_append(six, n - list_sum(six)::BIGINT) AS counts FROM c WHERE n >= 200),
st AS (SELECT lang, unnest(range(1, 8)) AS cls, unnest(list_transform(counts, lambda x: CAST(round_even(x * (1000.0::DOUBLE / n), 0) AS BIGINT))) AS step FROM c7),
md AS (SELECT lang, cls, step FROM st QUALIFY row_number() OVER (PARTITION BY lang, cls ORDER BY step) = CAST(ceil(count(*) OVER (PARTITION BY lang, cls) / 2.0) AS BIGINT)),
pf AS (SELECT lang, list(step ORDER BY cls) AS q, sum(step) AS total FROM md GROUP BY lang),
pw AS (SELECT r, lang, unnest(regexp_extract_all(translate(translate(t, '{UPPER}', '{LOWER}'), '"''`()[]{{}}.,:;!?#*$%&|<>', ''), '{WORD}')) AS word FROM d),
dw AS (SELECT r, lang, word, count(*) AS c FROM pw GROUP BY ALL),
lw AS (SELECT lang, sum(c) AS n FROM dw GROUP BY lang),
al AS (SELECT sum(n) AS n FROM lw),
refs AS (SELECT lw.lang, lw.n FROM lw, al WHERE lw.n >= greatest(2000, al.n / 20000.0)),
cw AS (SELECT dw.lang, word, sum(c) AS n FROM dw, al GROUP BY dw.lang, word HAVING sum(c) >= any_value(al.n) / 20000.0),
rw AS (SELECT cw.lang, word, cw.n::DOUBLE / refs.n AS q FROM cw JOIN refs ON cw.lang IS NOT DISTINCT FROM refs.lang),
rt AS (SELECT lang, count(*) AS words, sum(q) AS qs FROM rw GROUP BY lang),
tot AS (SELECT r, lang, sum(c)::DOUBLE AS m FROM dw GROUP BY ALL),
hit AS (SELECT dw.r, sum({_P_LOG('(dw.c / tot.m)', 'rw.q')}) AS s, sum(dw.c) / any_value(tot.m) AS ps, sum(rw.q) AS qs FROM dw JOIN tot ON tot.r = dw.r JOIN rw ON rw.word = dw.word AND rw.lang IS NOT DISTINCT FROM dw.lang GROUP BY dw.r),
wd AS (SELECT tot.r, sqrt(greatest(0, (coalesce(s, 0) + {_P_LOG('(1 - coalesce(ps, 0))', '(1 - rt.qs)')} + rt.qs - coalesce(hit.qs, 0)) / 2)) AS dist
       FROM tot JOIN rt ON rt.lang IS NOT DISTINCT FROM tot.lang LEFT JOIN hit ON hit.r = tot.r WHERE rt.words >= 20),
cx AS (SELECT c7.r, unnest(counts)::DOUBLE / c7.n AS p, unnest(q)::DOUBLE / total AS q FROM c7 JOIN pf ON pf.lang IS NOT DISTINCT FROM c7.lang JOIN refs ON refs.lang IS NOT DISTINCT FROM c7.lang),
cd AS (SELECT r, sqrt(greatest(0, sum({_P_LOG('p', 'q')}) / 2)) AS dist FROM cx GROUP BY r),
v AS (SELECT doc_id, base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(cd.dist, 0) AS cdist, CASE WHEN n_words >= 60 THEN coalesce(wd.dist, 0) ELSE 0 END AS wdist
      FROM d JOIN base USING (r) LEFT JOIN cd USING (r) LEFT JOIN wd USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (cdist > 0.185 OR wdist > greatest(0.4, 1.14 - 0.092 * ln(greatest(n_words, 1)))) AS kept FROM v
"""


def _crc_entry(n: int) -> int:
    """An entry of the checksum's table, by its reversed polynomial."""
    for _ in range(8):
        n = 0xEDB88320 ^ n >> 1 if n & 1 else n >> 1
    return n


_CRC_TABLE = "[" + ", ".join(str(_crc_entry(n)) for n in range(256)) + "]::BIGINT[]"

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hx AS (SELECT r, hex(encode(t)) AS h FROM d),
crc AS (SELECT r, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda c, b: xor(({_CRC_TABLE})[1 + (xor(c, b) & 255)], c // 256))) AS v FROM hx),
k AS (SELECT r, doc_id, CAST(strlen(t) AS BIGINT) + 16 AS size, substr(md5(t), 1, 16) || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM d),
total AS (SELECT sum(size)::DOUBLE AS b FROM k),
goals AS (SELECT unnest(range(1, 40)) AS i),
depths AS (SELECT unnest(range(3, 34, 3)) AS d),
buckets AS (SELECT d, substr(key, 1, d) AS p, sum(size) AS b, count(*) AS n FROM k, depths GROUP BY 1, 2),
edges AS (SELECT d, n, b, sum(b) OVER (PARTITION BY d ORDER BY p) AS hi FROM buckets),
near AS (SELECT i, d, min(abs(e - i * total.b / 40)) AS off, arg_min(e, (abs(e - i * total.b / 40), e)) AS edge FROM (SELECT d, hi AS e FROM edges UNION ALL SELECT d, 0 FROM depths), goals, total GROUP BY 1, 2),
holder AS (SELECT i, d, max(n) AS n FROM edges, goals, total WHERE hi - edges.b <= i * total.b / 40 AND hi > i * total.b / 40 GROUP BY 1, 2),
chosen AS (SELECT i, arg_min(edge, d) AS edge FROM near JOIN holder USING (i, d), total WHERE off <= 0.005 * total.b / 40 OR holder.n = 1 OR d >= 32 GROUP BY 1),
ranked AS (SELECT k.*, coalesce(sum(size) OVER (ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS below FROM k),
placed AS (SELECT ranked.*, (SELECT count(*) FROM chosen WHERE edge <= below) AS shard FROM ranked)
SELECT doc_id, size, v AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed JOIN crc USING (r)
"""


def crc32_sql(text: str) -> str:
    """The unsigned checksum of an ASCII text."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
        f"lambda c, b: xor(({_CRC_TABLE})[1 + (xor(c, b) & 255)], c // 256)))"
    )


_ENDS = "sha256(coalesce(string_agg(CASE WHEN len(s) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), ''))"

OP11 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': left(sha256(strlen(r) || ':' || r || x), 32), 'b': strlen(x)}} ORDER BY turn NULLS FIRST, left(sha256(strlen(r) || ':' || r || x), 32)) AS t,
      {crc32_sql('conv_id::VARCHAR')} % 9 AS h FROM t GROUP BY conv_id),
s AS (SELECT o.conv_id, list_concat(coalesce(b.t, [])[:o.h], o.t[o.h + 1:]) AS s FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s),
q AS (SELECT *, array_to_string(list_transform(s[:d], lambda e: e.k), '') AS key, CASE WHEN d = 0 THEN 0 ELSE s[d].b END AS b FROM p),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, {_ENDS} AS ends_sha256 FROM q GROUP BY key, d),
up AS (SELECT n.*, left(key, greatest(32 * (d - 1), 0)) AS parent FROM n),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up WHERE d > 0 GROUP BY 1),
m AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (key)),
sub AS (SELECT left(m.key, 32 * a.d) AS key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.b) AS saved_tokens
        FROM m, (SELECT unnest(range(0, (SELECT max(d) + 1 FROM n))) AS d) a WHERE a.d <= m.d GROUP BY 1)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, CASE WHEN m.d > 0 THEN up.conv_id END AS parent_conv_id, m.n_convs, m.n_children, sub.n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN sub USING (key) JOIN n up ON up.key = m.parent
"""
