"""Findings of the third review: work in proportion, exact counts, patterns matched once."""

import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stallwise.functions import text
from stallwise.operators import access, questions, rollup, store
from stallwise.plans import driver_queries
from stallwise.sources import pages
from stallwise.streaming import daily


def test_totals_meet_accounts_once_a_tier(spark):
    """The totals are those of the entitled rows, also of an account with two tiers, and rows of days never meet accounts."""
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    rows = spark.createDataFrame([(p, day(n), n + 1) for p in "OFX" for n in range(40)], "platform_code string, observed_on date, listings long")
    accounts = spark.createDataFrame([(1, "free", True), (2, "pro", True), (3, "pro", False), (4, "free", True), (4, "pro", True), (5, "none", True)], "account_ref long, tier string, active boolean")
    tiers = spark.createDataFrame([("free", ["O"], 10), ("pro", ["O", "F"], None)], "tier string, platforms array<string>, history_days int")
    today = F.lit(day(39))
    want = access.entitled_rows(rows, accounts, tiers, today).groupBy("account_ref", "platform_code").agg(F.sum("listings"), F.min("observed_on"))
    got = access.entitled_totals(rows, accounts, tiers, today, {"listings": F.sum, "observed_on": F.min})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5


def test_small_falls_and_halves_as_in_sql(spark):
    """A fall of less than half a tenth is -0.0, as in SQL, and halves of the tenfold value are those of the double."""
    import duckdb

    values = [-0.06, -0.04, 0.0, 0.04, 0.25, 2.25, 1005 / 100, 8.35, 9.95, 12.75, -3.05, 72.35]
    got = [str(r[0]) for r in spark.createDataFrame([(v,) for v in values], "v double").select(rollup.tenths(F.col("v"))).collect()]
    assert got == [str(duckdb.execute("SELECT round(?::DOUBLE, 1)", [v]).fetchone()[0]) for v in values]
    days = [(datetime.date(2024, 1, d), Decimal(10_000 - d)) for d in (1, 2, 3)]
    series = spark.createDataFrame([("c", "p", d, m, 5) for d, m in days], "category_code string, platform_code string, observed_on date, median decimal(12,2), observation_count long")
    row = rollup.price_trend(series).first()
    assert str(row["change_percent"]) == "-0.0" and row["direction"] == "flat"


def test_activity_is_exact(spark, tmp_path):
    """Sellers seen in several micro-batches, null and negative ones included; far more than a sketch counts exactly."""
    moment = F.lit(datetime.datetime(2024, 1, 1, 5))
    rows = lambda k: spark.range(30_000).select(moment.alias("ts"), F.lit("c").alias("category_code"), F.when(F.col("id") % 100 > 0, F.col("id") * 3 - 20_000 + k * 7_500).alias("seller_name"))
    for k in range(3):
        rows(k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows(0).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    daily.activity_bitmaps(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/store")
    want = rows(0).unionByName(rows(1)).unionByName(rows(2)).agg(F.count("*"), F.count_distinct("seller_name")).first()
    for keys in (("day", "category_code"), ("category_code",)):
        got = daily.exact_activity(kept, keys).collect()
        assert [(r["listings"], r["sellers"]) for r in got] == [tuple(want)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_price_patterns_are_matched_once(spark):
    """Each end of a range is matched once in the plan."""
    rows = spark.createDataFrame([("KSh 1.5k - KSh 500",), ("1,299/=",), ("KSh 5 - 90",), ("900 to contact us",), (" 2500 K bob",), ("40 – 30 – 20",), (None,)], "raw string")
    ranges = rows.select(text.parse_price_range(F.col("raw")).alias("r")).select("r.low", "r.high")
    money = lambda *p: tuple(None if v is None else Decimal(v).quantize(Decimal("0.0001")) for v in p)
    assert [tuple(r) for r in ranges.collect()] == [money(500, 1500), money(1299, 1299), (None, None), (None, None), money(2_500_000, 2_500_000), money(30, 40), (None, None)]
    assert plan(ranges).count("shillings") <= 2
    assert plan(rows.select(text.parse_price(F.col("raw")).alias("p"))).count("shillings") == 1


def test_cards_and_items_are_picked_once(spark):
    """A filter on a card's fields does not match its patterns again."""
    html = '<article class="prd"><a href="/p" data-sku="k"><h3 class="name">A &amp; B</h3><div class="prc">KSh 900</div></a></article><div class="product-item"><a href="/i"><p class="title">Six letters</p><i class="price">70</i></a>'
    found = spark.createDataFrame([("http://x/", html, datetime.date(2024, 1, 1))], "url string, html string, fetched_on date")
    cards, items = pages.extract_cards(found, "web"), pages.extract_items(found, "web")
    assert [(r["title"], r["price_kes"], r["source_key"]) for r in cards.collect()] == [("A & B", Decimal("900.00"), "web:k")]
    assert [(r["title"], r["price_kes"]) for r in items.collect()] == [("Six letters", Decimal("70.00"))]
    assert plan(cards).count("prc[^") == 1 and plan(items).count("price[^") == 1


def test_small_vocabularies_take_no_exchange(spark):
    """Aliases of a dictionary are tried in the row, with the results of the table of aliases."""
    vocabularies = {"category_code": {"gears": ["gear", "city gear"], "cities": ["city"]}, "county_code": {"n1": ["c++ 4", "one two three four five six seven"]}}
    asked = spark.createDataFrame([("Price of CITY gears?",), ("cities, agear",), ("c++ 4s", ), ("gear_x",), ("one two three four five six seven",), ("",), (None,), ("égear",)], "question string")
    routed = questions.route_questions(asked, vocabularies)
    table = questions.route_questions(asked, (questions.alias_table(spark, vocabularies), list(vocabularies)))
    assert "Exchange" not in routed._jdf.queryExecution().executedPlan().toString()
    columns = sorted(routed.columns)
    assert sorted(map(str, routed.select(*columns).collect())) == sorted(map(str, table.select(*columns).collect()))
    assert [r["category_code"] for r in routed.select("category_code").collect()] == ["gears", "cities", None, None, None, None, None, None]


def test_examples_order_only_near_rows(spark):
    """Ties at the last distance are broken by the order; groups of fewer rows than the limit are whole."""
    rows = [("c", "p", 10 + i % 5, f"t{i}", "s", f"u{i}", i) for i in range(40)] + [("d", "p", 7, "t", "s", "u", 1), ("d", "p", 9, "t", "s", "v", 2)]
    listings = spark.createDataFrame(rows, "category_code string, platform_code string, price_kes int, title string, seller_name string, source_url string, at int")
    out = rollup.example_listings(listings, ["at"])
    assert sorted((r["category_code"], r["rank"], r["url"]) for r in out.collect()) == [("c", 1, "u2"), ("c", 2, "u7"), ("c", 3, "u12"), ("d", 1, "v"), ("d", 2, "u")]
    assert "_reach" in plan(out)


def test_a_micro_batch_has_as_many_files_as_its_rows_were_written_in(spark, tmp_path):
    """a fifth of the events was one file, written and read by one task; five fifths stay five micro-batches."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    folder = driver_queries._histogram(spark, str(tmp_path), "f11", rollups=True)
    files = [f.name for f in Path(folder.removeprefix("file:")).glob("arrived/*.parquet")]
    assert len(files) > 5
    batches = spark.read.parquet(f"{folder}/store").agg(F.max("through")).first()[0]
    assert batches == 4
    assert spark.read.parquet(f"{folder}/store").agg(F.sum("n")).first()[0] == events.filter("value IS NOT NULL").count()


def test_an_append_keeps_no_rows_beside_the_table(spark, tmp_path, monkeypatch):
    """the batch was kept whole to be counted; it is counted as it is written, also where nothing is new."""
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *_: pytest.fail("an append keeps rows"))
    day = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([("p", f"k{i % 40}", day, i, i) for i in range(200)] + [("p", None, day, 1, 300)], "platform_code string, source_key string, observed_on date, price_kes int, at int")
    table = store.ListingTable(spark, "round4_listings", f"{tmp_path}/t", buckets=4, period="month")
    files = lambda: len(list(tmp_path.glob("t/*/*.parquet")))
    try:
        assert table.append(rows.limit(0), ["at"]) == 0 and files() == 0
        assert table.append(rows.filter("at < 20"), ["at"]) == 20
        assert table.append(rows.filter("source_key IS NOT NULL"), ["at"]) == 20
        before = files()
        assert table.append(rows.filter("source_key IS NOT NULL"), ["at"]) == 0 and files() == before
        assert table.append(rows, ["at"]) == 1
        assert table.rows().count() == 41
    finally:
        table.forget()
