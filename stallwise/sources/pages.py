"""Listings and links out of stored web pages, by patterns and JSON, on the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.functions.text import normalise_sku, once, parse_price
from stallwise.operators.store import in_currency, seller_of

# What a challenge page says in its first characters, and what one says that is short as a whole.
CHALLENGE = ["captcha", "are you a robot", "access denied", "cf-browser-verification", "checking your browser"]
SHORT_CHALLENGE = ["captcha", "access denied", "are you a robot", "verify you are human", "cf-browser-verification"]
CHALLENGE_CHARS, SHORT_PAGE = 4000, 800
LD_JSON = r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def _parsed(rows: DataFrame, kept: list[str], **fields: Column) -> DataFrame:
    """``kept`` columns and ``fields``, each computed once a row: filters and orders on them stay above."""
    made = rows.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))).alias("_f"))
    return made.select(*kept, *[F.col(f"_f.{n}").alias(n) for n in fields])


def clean_markup(html: Column) -> Column:
    """Text without tags, entities decoded, single spaces."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " ")), r"[\s\u00a0]+", " "))


def decode_entities(text: Column) -> Column:
    """Named entities of HTML 4 and the apostrophe, and decimal and hexadecimal ones; others stay as they are."""
    found = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    names = {**{name: chr(point) for name, point in name2codepoint.items()}, "apos": "'"}
    named = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))

    def char(entity: Column) -> Column:
        is_hex = F.lower(F.substring(entity, 2, 1)) == "x"
        digits = F.when(is_hex, F.substring(entity, 3, 7)).otherwise(F.conv(F.substring(entity, 2, 8), 10, 16))
        point = F.conv(digits, 16, 10).cast("int")
        real = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        numeric = F.when(real, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        return F.coalesce(F.when(entity.startswith("#"), numeric).otherwise(named[entity]), F.concat(F.lit("&"), entity, F.lit(";")))

    def decoded(t: Column) -> Column:
        entities = F.transform(F.regexp_extract_all(t, F.lit(found), 1), char)
        joined = F.array_join(F.zip_with(F.split(t, found, -1), entities, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
        return F.when(t.contains("&"), joined).otherwise(t)

    return once(text, decoded)


def blocked_page(html: Column, short_only: bool = False) -> Column:
    """Whether a page is a challenge: its markers stand in its first 4,000 characters, or, with ``short_only``, in a page below 800."""
    text = F.lower(F.substring(html, 1, CHALLENGE_CHARS))
    found = _any([text.contains(m) for m in (SHORT_CHALLENGE if short_only else CHALLENGE)])
    return found & (F.length(html) < SHORT_PAGE) if short_only else found


def heading(html: Column) -> Column:
    """The page's title: ``og:title``, else the first ``h1``; null without either."""
    og = F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)
    h1 = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.coalesce(F.nullif(clean_markup(og), F.lit("")), F.nullif(clean_markup(h1), F.lit("")))


def nav_breadcrumb(html: Column, drop: tuple[str, ...] = ("home",), most: int = 4) -> Column:
    """The first ``most`` link texts of the first ``nav``, less the dropped ones, joined by `` > ``."""
    nav = F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    links = F.transform(F.regexp_extract_all(nav, F.lit(r"(?is)<a[^>]*>(.*?)</a>"), 1), clean_markup)
    kept = F.slice(F.filter(links, lambda x: (x != "") & ~F.lower(x).isin(*drop)), 1, most)
    return F.nullif(F.array_join(kept, " > "), F.lit(""))


def ld_nodes(html: Column) -> Column:
    """The JSON-LD objects of a page in page order: of all blocks, through arrays, ``@graph`` and ``mainEntity``."""
    none = F.array().cast("array<variant>")
    inside = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), none)
    parsed = F.transform(F.coalesce(F.regexp_extract_all(html, F.lit(LD_JSON), 1), F.array().cast("array<string>")), F.try_parse_json)
    of_block = lambda v: F.array_compact(F.concat(F.array(v, F.try_variant_get(v, "$.mainEntity", "variant")), inside(v, "$"), inside(v, '$["@graph"]')))
    return F.flatten(F.transform(parsed, of_block))


def _of_type(nodes: Column, kind: str) -> Column:
    """The first node of a type, null without one."""
    return F.get(F.filter(nodes, lambda n: F.coalesce(F.try_variant_get(n, '$["@type"]', "string") == kind, F.lit(False))), F.lit(0))


def listed_breadcrumb(nodes: Column) -> Column:
    """The names of the page's BreadcrumbList, joined by `` > ``."""
    items = F.try_variant_get(_of_type(nodes, "BreadcrumbList"), "$.itemListElement", "array<variant>")
    names = F.filter(F.transform(items, lambda i: F.try_variant_get(i, "$.name", "string")), lambda n: n.isNotNull() & (n != ""))
    return F.nullif(F.array_join(names, " > "), F.lit(""))


def extract_products(pages: DataFrame, platform: str, own_brand: str | None = None, short_challenges: bool = False) -> DataFrame:
    """Listings from the pages' JSON-LD, with the heading and ``data-price`` where it lacks a name or a price.

    The first Product in page order counts; it is found inside the row, so pages are not
    exchanged and each row of ``pages`` gives one row at most. A page without title or
    price gives none. The seller is the offer's, else the brand, and null where that is
    ``own_brand``, the platform's own name. ``short_challenges`` tells how the platform's
    challenge pages are known.
    """
    rows = pages.select("url", "html", "fetched_on", ld_nodes(F.col("html")).alias("_nodes")).withColumn("_n", _of_type(F.col("_nodes"), "Product"))
    first = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get("_n", p, "string"), F.lit("")) for p in paths])
    offer = lambda field: first(f"$.offers.{field}", f"$.offers[0].{field}")
    brand = first("$.brand.name", "$.brand")
    out = rows.select(
        F.lit(platform).alias("platform_code"),
        F.col("url").alias("source_url"),
        F.coalesce(first("$.name"), heading(F.col("html"))).alias("title"),
        parse_price(F.coalesce(offer("price"), F.regexp_extract("html", r'data-price="([^"]+)"', 1))).cast("decimal(12,2)").alias("price_kes"),
        offer("priceCurrency").alias("currency"),
        normalise_sku(F.lit(platform), first("$.sku", "$.mpn")).alias("source_key"),
        brand.alias("brand"),
        seller_of(offer("seller.name"), brand, own_brand).alias("seller_name"),
        offer("availability").contains("InStock").alias("in_stock"),
        first("$.aggregateRating.ratingValue").try_cast("decimal(3,2)").alias("rating"),
        first("$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount").try_cast("int").alias("rating_count"),
        F.coalesce(nav_breadcrumb(F.col("html")), listed_breadcrumb(F.col("_nodes"))).alias("breadcrumb"),
        F.col("fetched_on").alias("observed_on"),
        blocked_page(F.col("html"), short_challenges).alias("_blocked"),
    )
    return out.filter("title IS NOT NULL AND price_kes IS NOT NULL AND NOT _blocked").filter(in_currency(F.col("currency"))).drop("_blocked", "currency")


def extract_cards(pages: DataFrame, platform: str) -> DataFrame:
    """Listings from the product cards of category pages; cards without link, name or readable price are left out.

    Of a product on several pages the first card of the first page counts.
    """
    card = r'(?is)<article[^>]*class="[^"]*prd[^"]*"[^>]*>(.*?)</article>'
    cards = pages.select("url", "fetched_on", F.posexplode(F.regexp_extract_all("html", F.lit(card), 1)).alias("pos", "_card"))
    pick = lambda pattern: F.nullif(F.regexp_extract("_card", pattern, 1), F.lit(""))
    rows = _parsed(
        cards, ["url", "pos", "fetched_on"],
        platform_code=F.lit(platform),
        source_url=pick(r'(?is)<a[^>]*href="([^"]+)"'),
        title=clean_markup(pick(r'(?is)<h3[^>]*class="[^"]*name[^"]*"[^>]*>(.*?)</h3>')),
        price_kes=parse_price(clean_markup(pick(r'(?is)<div[^>]*class="[^"]*prc[^"]*"[^>]*>(.*?)</div>'))).cast("decimal(12,2)"),
        source_key=normalise_sku(F.lit(platform), F.coalesce(pick(r'data-(?:sku|id)="([^"]*)"'), pick(r'(?is)<a[^>]*href="([^"]+)"'))),
        brand=pick(r'data-(?:ga4-item_)?brand="([^"]*)"'),
    ).filter("source_url IS NOT NULL AND title IS NOT NULL AND price_kes IS NOT NULL")
    rows = rows.select("platform_code", "url", "pos", "source_url", "title", "price_kes", "source_key", "brand", F.col("fetched_on").alias("observed_on"))
    order = Window.partitionBy("source_key", "observed_on").orderBy(page_number(F.col("url")), "url", "pos")
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth", "url", "pos")


def page_number(url: Column) -> Column:
    """The number of a result page, by its ``page`` parameter; 1 without one."""
    return F.coalesce(F.regexp_extract(url, r"[?&]page=(\d{1,9})(?!\d)", 1).try_cast("int"), F.lit(1))


def extract_items(pages: DataFrame, platform: str, shortest_title: int = 6) -> DataFrame:
    """Listings from pages that mark each product as a ``product-item`` block; a product counts once a page."""
    item = r'(?is)<div[^>]*class="[^"]*product-item[^"]*"[^>]*>(.*?)(?=<div[^>]*class="[^"]*product-item|\z)'
    items = pages.select("url", "fetched_on", F.posexplode(F.regexp_extract_all("html", F.lit(item), 1)).alias("pos", "_item"))
    link = F.nullif(F.regexp_extract("_item", r'(?is)<a[^>]*href="([^"]+)"', 1), F.lit(""))
    rows = _parsed(
        items, ["url", "pos", "fetched_on"],
        platform_code=F.lit(platform),
        source_url=link,
        title=clean_markup(F.regexp_extract("_item", r'(?is)<[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</', 1)),
        price_kes=parse_price(clean_markup(F.regexp_extract("_item", r'(?is)<[^>]*class="[^"]*price[^"]*"[^>]*>(.*?)</', 1))).cast("decimal(12,2)"),
        source_key=normalise_sku(F.lit(platform), link),
    ).filter((F.length("title") >= shortest_title) & F.col("price_kes").isNotNull() & F.col("source_key").isNotNull())
    rows = rows.select("platform_code", "url", "pos", "source_url", "title", "price_kes", "source_key", F.col("fetched_on").alias("observed_on"))
    order = Window.partitionBy("url", "source_key", "observed_on").orderBy("pos")
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth", "url", "pos")


def url_allowed(url: Column, rules: dict) -> Column:
    """Whether a url may be fetched: query strings first, then explicit allows, prefixes and fragments; else yes."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    allowed = _any([path.endswith(a[2:]) for a in rules.get("allowed_paths", ()) if a.startswith("/*.")] + [path.startswith(a) for a in rules.get("allowed_paths", ()) if not a.startswith("/*")])
    prefix = _any([path.startswith(p) for p in rules.get("disallowed_prefixes", ())])
    fragment = _any([path.contains(f) for f in rules.get("disallowed_fragments", ())])
    faceted = (query != "") if rules.get("disallow_query_strings") else F.lit(False)
    return F.when(faceted, False).when(allowed, True).otherwise(~prefix & ~fragment)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def sitemap_urls(sitemaps: DataFrame, rules: dict, limit: int | None = None) -> DataFrame:
    """Product urls of sitemaps (``name``, ``content``): permitted ones ending in ``.html``, product sitemaps first, brand ones left out."""
    locs = sitemaps.filter(~F.lower("name").contains("brand")).select(
        "name", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)).alias("pos", "url")
    )
    kept = locs.filter(F.col("url").endswith(".html")).filter(url_allowed(F.col("url"), rules))
    kept = kept.orderBy(~F.lower("name").contains("product"), "name", "pos")
    return (kept.limit(limit) if limit is not None else kept).select("name", "pos", "url")


def read_sitemaps(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Stored sitemap files, whole, as ``name`` (the file's path) and ``content``; files ending in ``.gz`` are unpacked while they are read."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("content"))


def sitemap_index(sitemaps: DataFrame) -> DataFrame:
    """The child sitemaps that index files name: ``parent``, ``place`` in it, ``child``; those of products first, those of brands left out."""
    entry = F.regexp_extract_all("content", F.lit(r"(?s)<sitemap>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), 1)
    listed = sitemaps.select(F.col("name").alias("parent"), F.posexplode(entry).alias("_at", "child")).filter(~F.lower("child").contains("brand"))
    order = Window.partitionBy("parent").orderBy(~F.lower("child").contains("product"), "_at")
    return listed.select("parent", (F.row_number().over(order) - 1).alias("place"), "child")


def indexed_urls(sitemaps: DataFrame, rules: dict, limit: int | None = None) -> DataFrame:
    """The product urls of all sitemaps an index leads to: ``parent``, ``place``, ``child``, ``pos``, ``url``.

    Index entries meet the stored files by name, or by its end where files are stored under a
    folder (the part after the last slash). Files that are no index and in none stand for themselves.
    A child that was not stored has no urls. ``limit`` keeps the first of each index.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    is_index = F.col("content").contains("<sitemapindex")
    index = sitemap_index(sitemaps.filter(is_index))
    maps = sitemaps.filter(~is_index).select(last(F.col("name")).alias("_file"), "name", "content")
    children = index.withColumn("_file", last(F.col("child"))).join(maps, "_file")
    alone = maps.join(index.select(last(F.col("child")).alias("_file")).distinct(), "_file", "left_anti")
    alone = alone.filter(~F.lower("name").contains("brand")).select("_file", F.col("name").alias("parent"), F.lit(0).alias("place"), F.col("name").alias("child"), "name", "content")
    locs = F.regexp_extract_all("content", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)
    urls = children.unionByName(alone).select("parent", "place", "child", F.posexplode(locs).alias("pos", "url"))
    urls = urls.filter(F.col("url").endswith(".html") & url_allowed(F.col("url"), rules))
    if limit is None:
        return urls
    first = Window.partitionBy("parent").orderBy("place", "pos")
    return urls.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= limit).drop("_nth")
