"""The listing table, title dictionary, alias table, guards, payloads, sitemap files and evidence."""

import gzip
import time
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallwise.operators import classify, questions, rollup, store
from stallwise.sources import pages

ROW = "platform_code string, source_key string, observed_on date, price_kes int, at int"


def fails_with(message, job):
    with pytest.raises(Exception, match=message):
        job()


def test_listing_table(spark, tmp_path):
    days = [date(2024, 1, 1), date(2024, 1, 9), date(2025, 3, 1)]
    rows = [("p", f"k{i % 40}", days[i % 3], i, i) for i in range(200)] + [("p", None, days[0], -1, 500), ("p", None, days[0], -2, 501), ("p1", ":k", days[0], 7, 9), ("p", "1:k", days[0], 8, 9)]
    df = spark.createDataFrame(rows, ROW)
    table = store.ListingTable(spark, "round3_listings", f"{tmp_path}/t", buckets=4, period="month")
    first, later = df.filter("at % 2 = 0"), df
    try:
        assert table.append(first, ["at"]) == first.select(*store.KEY).filter("source_key IS NOT NULL").distinct().count() + 1
        fresh = table.fresh(later, ["at"])
        got = sorted(map(tuple, fresh.select(*store.KEY, "price_kes", "at").collect()), key=repr)
        seen = {(r[0], r[1], r[2]) for r in rows if r[4] % 2 == 0 and r[1]}
        want = {}
        for r in sorted(rows, key=lambda r: r[4]):
            if r[1] and (r[0], r[1], r[2]) not in seen:
                want.setdefault((r[0], r[1], r[2]), r)
        assert got == sorted([*want.values(), *[r for r in rows if r[1] is None]], key=repr)
        limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the store of a test is small enough to be sent around
        try:
            executed = table.fresh(later, ["at"])._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert executed.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in executed and "LeftAnti" in executed
        of_store = executed[executed.index("FileScan parquet spark_catalog") :]
        assert "PartitionFilters: [period" in of_store and "unit" in of_store.split("]")[0]
        before = executed[: executed.index("FileScan parquet spark_catalog")]
        assert "Exchange" not in before[before.rindex("Sort [unit") :]
        assert table.append(later, ["at"]) == len(want) + 2
        assert table.fresh(later.filter("source_key IS NOT NULL"), ["at"]).count() == 0
        assert table.append(df.limit(0), ["at"]) == 0
        assert sorted(table.rows().columns) == sorted(df.columns)
    finally:
        table.forget()


def test_days_of_a_wide_batch(spark):
    stored = spark.range(4000).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("observed_on"))
    assert store.of_days(stored, stored.limit(3)).count() == 3
    assert store.of_days(stored, stored.filter("observed_on < '2024-01-01'")).count() == 1461
    assert store.of_days(stored, stored.limit(0)).count() == 0


def test_title_dictionary(spark, tmp_path):
    rules = classify.Taxonomy(keywords={"phones": ["phone"], "cables": ["cable"]})
    rows = spark.createDataFrame([(1, "Red phone", None, "old"), (2, "USB cable", "x > cable", "old"), (3, "Red phone", None, "old"), (4, None, "phone", "old"), (5, "", None, "old"), (6, "Red phone", "cable", "old")], "id int, title string, breadcrumb string, category_code string")
    titles = classify.TitleDictionary(f"{tmp_path}/d", rules)
    titles.learn(rows.filter("id < 3"))
    assert sorted(r["id"] for r in titles.enrich(rows).collect()) == [1, 2, 3]
    titles.learn(rows)
    titles.learn(rows)
    assert titles.known(spark).count() == 5
    columns = ["id", "category_code", "hit_count", "confidence", "all_matches", "aggregatable"]
    plain = sorted(map(str, classify.enrich(rows, rules).select(columns).collect()))
    assert sorted(map(str, titles.enrich(rows).select(columns).collect())) == plain
    edited = classify.TitleDictionary(f"{tmp_path}/d", classify.Taxonomy(keywords={"phones": ["phone"], "leads": ["cable"]}))
    assert edited.path != titles.path and edited.known(spark) is None
    edited.learn(rows)
    assert {r["category_code"] for r in edited.enrich(rows).filter("id = 2").collect()} == {"leads"}
    same = classify.Taxonomy(keywords={"cables": ["cable"], "phones": ["phone"]})
    assert classify.TitleDictionary(f"{tmp_path}/d", same).path == titles.path


def test_aliases(spark):
    vocabulary = {"c": {"power": ["battery", "power bank", "bank"], "dress": ["dress", "party"]}, "p": {"m": ["mall", "big mall"]}}
    cases = {
        "Batteries?": ("power", None), "battery": ("power", None), "batterys": (None, None), "POWER BANKS or dresses": ("power", None), "banks": ("power", None), "bankses": (None, None),
        "powerbank": (None, None), "power  bank": ("power", None), "the big malls-party": ("dress", "m"), "dress, battery": ("power", None), "": (None, None), None: (None, None), "él bank_": (None, None), "ébank": (None, None),
    }
    asked = spark.createDataFrame([(i, q) for i, q in enumerate([*cases, "banks"])], "id int, question string").withColumn("c", F.lit("clash"))
    got = {r["id"]: (r["c"], r["p"]) for r in questions.match_aliases(asked, questions.alias_table(spark, vocabulary), ["c", "p"]).collect()}
    assert got == {i: cases[q] for i, q in enumerate([*cases, "banks"])}


def test_ten_thousand_aliases_plan_fast(spark):
    aliases = spark.range(10_000).select(F.lit("c").alias("name"), F.col("id").cast("string").alias("code"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("alias"), F.lit(0).alias("place"))
    asked = spark.range(50).select("id", F.concat(F.lit("price of item "), (F.col("id") * 7).cast("string"), F.lit("s")).alias("question"))
    questions.match_aliases(asked, aliases, ["c"])
    began = time.perf_counter()
    out = questions.match_aliases(asked, aliases, ["c"])
    out._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 1
    assert all(r["c"] == str(r["id"] * 7) for r in out.collect())


def test_guard_fails_the_job(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "platform_code string, x int")
    expected = spark.createDataFrame([("a",), ("b",)], "platform_code string")
    assert store.require_units(rows, expected, 1).count() == 3
    short = store.require_units(rows, expected, 2)
    fails_with("too few rows of b: 1, need 2", lambda: short.write.parquet(f"{tmp_path}/a"))
    fails_with("too few rows of b", short.count)
    fails_with("too few rows of b", lambda: short.select("x").filter("x > 100").collect())
    fails_with("too few rows of", lambda: store.require_units(rows.limit(0), expected, 1).write.parquet(f"{tmp_path}/b"))


LISTING = "category_code string, platform_code string, price_kes decimal(12,2), seller_name string, observed_on date, aggregatable boolean"


def test_unknown_platform_fails_the_job(spark, tmp_path):
    rows = spark.createDataFrame([("c", p, Decimal(i), "s", date(2024, 1, 1), True) for i in range(3) for p in "ab"], LISTING)
    one = spark.createDataFrame([("a", "slow")], "platform_code string, caveat string")
    both = one.unionByName(spark.createDataFrame([("b", None)], one.schema))
    fails_with("unknown platform b", lambda: rollup.rollup(rows, platforms=one).write.parquet(f"{tmp_path}/a"))
    fails_with("unknown platform b", rollup.rollup(rows, platforms=one).select("category_code").count)
    fails_with("unknown platform b", rollup.with_evidence(rows, one).collect)
    assert {r["platform_code"]: r["caveats"] for r in rollup.rollup(rows, platforms=both).collect()} == {"a": ["slow"], "b": []}
    e = rollup.with_evidence(rows, both, minimum=5).first()["evidence"]
    assert (e["observation_count"], e["platforms"], e["caveats"], e["collected_on"]) == (6, ["a", "b"], ["slow"], date(2024, 1, 1))
    each = {r["platform_code"]: r["evidence"]["platforms"] for r in rollup.with_evidence(rows, both, ("category_code", "platform_code")).collect()}
    assert each == {"a": ["a"], "b": ["b"]}


def test_rankings_of_a_choice(spark):
    rows = spark.createDataFrame([(c, p, True, n, n // 2) for c, n in (("x", 40), ("y", 60)) for p in "ab"], "category_code string, platform_code string, available boolean, observation_count long, seller_count long")
    ranked = lambda **chosen: [(r["category_code"], r["platform_code"]) for r in rollup.rank_activity(rows, **chosen).collect()]
    assert ranked() == [("y", "a"), ("y", "b"), ("x", "a"), ("x", "b")]
    assert ranked(platforms=["b"]) == [("y", "b"), ("x", "b")] and ranked(categories=["x"], platforms=["a", "z"]) == [("x", "a")] and ranked(platforms=[]) == []
    assert [r["category_code"] for r in rollup.rank_opportunity(rows, platforms=["a"]).collect()] == ["y", "x"]


def test_payload_is_a_variant(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"k": 5, "a": {"b": ["x", "y"]}}'), (2, "no json"), (3, None), (4, '{"k": "text"}')], "id int, raw string")
    store.with_payload(rows).write.parquet(f"{tmp_path}/p")
    kept = spark.read.parquet(f"{tmp_path}/p")
    assert dict(kept.dtypes)["raw"] == "variant"
    got = {r["id"]: (r["k"], r["b"]) for r in kept.select("id", store.payload("$.k", "int").alias("k"), store.payload("$.a.b[1]", "string").alias("b")).collect()}
    assert got == {1: (5, "y"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_sitemap_files(spark, tmp_path):
    loc = lambda *urls: "<urlset>" + "".join(f"<url>\n<loc> {u} </loc></url>" for u in urls) + "</urlset>"
    files = {
        "index.xml": "<sitemapindex>" + "".join(f"<sitemap>\n<loc>https://h/maps/{n}</loc></sitemap>" for n in ("brands-sitemap.xml", "other.xml", "products-sitemap1.xml.gz", "gone.xml")) + "</sitemapindex>",
        "brands-sitemap.xml": loc("https://h/b.html"), "other.xml": loc("https://h/o1.html", "https://h/list/"), "alone.xml": loc("https://h/z.html", "https://h/no/z.html"),
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "products-sitemap1.xml.gz").write_bytes(gzip.compress(loc("https://h/p1.html", "https://h/p2.html").encode()))
    maps = pages.read_sitemaps(spark, str(tmp_path))
    assert maps.count() == 5
    found = lambda **k: [(r["parent"].rsplit("/", 1)[-1], r["place"], r["url"]) for r in pages.indexed_urls(maps, {"disallowed_prefixes": ["/no/"]}, **k).orderBy("parent", "place", "pos").collect()]
    want = [("alone.xml", 0, "https://h/z.html"), ("index.xml", 0, "https://h/p1.html"), ("index.xml", 0, "https://h/p2.html"), ("index.xml", 1, "https://h/o1.html")]
    assert found() == want and found(limit=2) == want[:3]


def test_numbered_pages(spark):
    number = lambda u: spark.range(1).select(pages.page_number(F.lit(u))).first()[0]
    assert [number(u) for u in ("http://x/a", "http://x/a?page=10", "http://x/a?q=1&page=2#t", "http://x/page=3", "http://x/?page=99999999999")] == [1, 10, 2, 1, 1]


def test_question_log(spark, tmp_path):
    answers = spark.createDataFrame([("ref", datetime(2024, 1, d, 9), "q?", "price_level", True, "t", 5) for d in (1, 2, 2)], "account_ref string, asked_at timestamp, question string, intent string, answered boolean, text string, observation_ct int")
    for _ in range(2):
        store.append_question_log(answers.withColumn("email", F.lit("no")), f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert {r["day"].day: r["count"] for r in log.groupBy("day").count().collect()} == {1: 2, 2: 4} and "email" not in log.columns
