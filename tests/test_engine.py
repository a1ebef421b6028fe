import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stallwise.operators import access, classify, costs, names, questions, rollup, store
from stallwise.sources import pages
from stallwise.streaming import daily, ingest

DAY = dt.date(2026, 9, 9)
RULES = classify.Taxonomy(
    keywords={"power_banks": ["power bank", "powerbank", "portable charger"], "toys": ["kids toy", "toy car"], "fashion": ["dress", "dresses", "skirt", "blouse"], "thrift": ["bale", "mtumba"], "pets": ["dog bed", "pet"]},
    accessory_markers={"charger": "power_banks", "charging plug": "power_banks"},
    qualified_markers=[("case for", "phone", ["samsung", "iphone"])],
    guard_exempt=["power_banks"],
    condition_overrides=["thrift"],
    service_markers=["salon", "repair service"],
)


def test_classify(spark):
    cases = {
        "Power Bank 10000mAh powerbank": ("power_banks", "high", "keyword", 2),
        "Universal Charging Plug For Kids Toy Vans": ("power_banks", "medium", "accessory_guard", 1),
        "12V Charger for ride on": ("power_banks", "medium", "accessory_guard", 1),
        "Camera Bale Dresses Skirt Blouse": ("thrift", "medium", "keyword", 1),
        "Case for Samsung A5": ("phone", "medium", "accessory_guard", 1),
        "Case for guitar": (None, "none", None, 0),
        "Dog bed pet charger": ("pets", "high", "keyword", 2),
        "Dress salon": ("fashion", "low", "keyword", 1),
        "charger repair service": ("power_banks", "medium", "accessory_guard", 1),
        "balearic island": (None, "none", None, 0),
        None: (None, "none", None, 0),
    }
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(cases)], "i int, title string, confidence string")
    got = classify.enrich(df, RULES, breadcrumb=None).orderBy("i").collect()
    assert [(r["category_code"], r["confidence"], r["classified_by"], r["hit_count"]) for r in got] == list(cases.values())
    assert [r["aggregatable"] for r in got] == [c[0] is not None and c[1] != "low" for c in cases.values()]


def test_breadcrumb_counts(spark):
    df = spark.createDataFrame([("Thing", "Home > Pet")], "title string, breadcrumb string")
    assert classify.enrich(df, RULES).first()["category_code"] == "pets"


def listing(i, price, day=DAY, seller=None, platform="p", category="c"):
    return (platform, f"{platform}:{i}", day, D(price), seller or f"s{i % 10}", category, True)


LISTING = "platform_code string, source_key string, observed_on date, price_kes decimal(12,2), seller_name string, category_code string, aggregatable boolean"


def test_rollup_and_refusal(spark):
    rows = [listing(i, 2000 + 10 * i) for i in range(40)] + [listing(i, 5, platform="q") for i in range(29)]
    rows += [(*listing(i, 999999)[:-1], False) for i in range(20)]
    got = {r["platform_code"]: r for r in rollup.rollup(spark.createDataFrame(rows, LISTING)).collect()}
    assert (got["p"]["median"], got["p"]["min"], got["p"]["max"], got["p"]["seller_count"]) == (D("2195.00"), 2000, 2390, 10)
    assert got["p"]["saturation_label"] == "crowded" and got["p"]["available"]
    assert not got["q"]["available"] and got["q"]["median"] is None and got["q"]["needed"] == 30 and "29 observations" in got["q"]["reason"]


def test_trend(spark):
    def series(*values):
        return [("c", str(values), DAY + dt.timedelta(i), D(v), 5) for i, v in enumerate(values)]

    rows = series(800, 720, 649) + series(500, 503, 505) + series(500) + series(100, 90, 120)
    df = spark.createDataFrame(rows, "category_code string, platform_code string, observed_on date, median decimal(12,2), observation_count int")
    got = {r["platform_code"]: (r["available"], r["direction"], r["change_kes"]) for r in rollup.price_trend(df).collect()}
    assert got["(800, 720, 649)"] == (True, "falling", D("-151.00")) and got["(500, 503, 505)"][1] == "flat"
    assert got["(500,)"][0] is False and got["(100, 90, 120)"][1] == "rising"


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    day2 = DAY + dt.timedelta(1)
    rows = [(*listing(1, 10), 1), (*listing(1, 11), 2), (*listing(1, 12, day=day2), 3), (*listing(1, 12, platform="q"), 4)]
    batch = spark.createDataFrame(rows, LISTING + ", at int")
    assert store.append_listings(batch, path, ["at"]) == 3
    assert store.append_listings(batch, path, ["at"]) == 0
    kept = spark.read.parquet(path)
    assert kept.count() == 3 and kept.filter("platform_code = 'p'").agg(F.min("price_kes")).first()[0] == 10


def test_scan_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"platform_code":"p","source_key":"p:1","price_kes":"12.345","observed_on":"2026-09-09"}\n\nnot json\n')
    got = store.scan_listings(spark, str(tmp_path / "a.jsonl")).orderBy("_corrupt_record").collect()
    assert [r["price_kes"] for r in got] == [D("12.35"), None] or [r["price_kes"] for r in got] == [D("12.34"), None]
    assert got[1]["_corrupt_record"] == "not json"


def test_summary_guard_and_stats(spark):
    rows = spark.createDataFrame([("p", "c", True), ("p", None, False), ("q", "c", False)], "platform_code string, category_code string, aggregatable boolean")
    got = {(r["scope"], r["code"]): (r["total"], r["classified"], r["aggregatable"], r["classification_rate"]) for r in store.run_summary(rows).collect()}
    assert got[("run", None)] == (3, 2, 1, 0.667) and got[("platform", "p")] == (2, 1, 1, 0.5) and got[("category", "c")][0] == 2
    expected = spark.createDataFrame([("p",), ("z",)], "platform_code string")
    assert {r["platform_code"]: (r["n_rows"], r["passed"]) for r in store.guard_not_empty(rows, expected, 2).collect()} == {"p": (2, True), "z": (0, False)}


def test_margin(spark):
    df = spark.createDataFrame([(D("649"), D("0.11"), D("145")), (D("200"), D("0.13"), D("150")), (D("10"), None, None)], "median decimal(12,2), commission_rate decimal(5,4), last_mile_kes decimal(12,2)")
    a, b, c = costs.landed_cost_ceiling(df).collect()
    assert (a["commission_kes"], a["landed_cost_ceiling_kes"], a["viable"]) == (D("71.39"), D("237.91"), True)
    assert not b["viable"] and not c["margin_available"] and len(c["missing"]) == 2


POLICY = "platform_code string, name string, per_category_rates_apply boolean, range_low decimal(5,4), range_high decimal(5,4), payout_days int, fees array<struct<name:string,basis:string,value:decimal(12,2)>>"


def compared(spark, fee_b, price=1000):
    policy = spark.createDataFrame(
        [
            ("a", "A", True, None, None, 14, [("return", "per_return", D(150)), ("storage", "per_unit_per_month", D(20))]),
            ("b", "B", False, D("0.05"), D("0.12"), 3, [("return", "per_return", fee_b)]),
            ("n", "N", False, None, None, None, []),
        ],
        POLICY,
    )
    rates = spark.createDataFrame([("c", D("0.06"))], "category_code string, commission_rate decimal(5,4)")
    delivery = spark.createDataFrame([("a", "x", D(100)), ("b", "x", D(100)), ("n", "x", D(100))], "platform_code string, county_code string, door_delivery decimal(12,2)")
    figures = [("c", p, True, 40, 9, D(price), D(900), D(1100), DAY) for p in "abn"]
    rollups = spark.createDataFrame(figures, "category_code string, platform_code string, available boolean, observation_count long, seller_count long, median decimal(12,2), p25 decimal(12,2), p75 decimal(12,2), collected_on date")
    wanted = spark.createDataFrame([("c", p, "x") for p in "abn"] + [("d", "a", "x")], "category_code string, platform_code string, county_code string")
    return costs.compare_market(rollups, wanted, policy, rates, delivery)


def test_compare_ranks_by_what_is_kept(spark):
    columns = compared(spark, None)
    got = {(r["category_code"], r["platform_code"]): r for r in columns.collect()}
    assert got["c", "a"]["net_receipt_kes"] == D("812.50") and got["c", "a"]["other_fees_kes"] == D("27.50")
    assert got["c", "b"]["commission_rate"] == D("0.0850") and got["c", "b"]["net_receipt_kes"] == D("815.00") and got["c", "b"]["rank"] == 1
    assert got["c", "n"]["net_receipt_kes"] is None and got["c", "n"]["rank"] == 3 and not got["c", "n"]["comparable"]
    assert got["d", "a"]["gaps"] == ["not collected yet"]
    verdict = {r["category_code"]: r for r in costs.verdicts(columns).collect()}
    assert (verdict["c"]["best"], verdict["c"]["lead_kes"], verdict["c"]["unproven"], verdict["c"]["may_flip"]) == ("b", D("2.50"), True, True)
    assert verdict["c"]["faster_payer"] is None and not verdict["d"]["decided"]
    sure = {r["category_code"]: r for r in costs.verdicts(compared(spark, D(300))).collect()}["c"]
    assert (sure["best"], sure["unproven"], sure["faster_payer"]) == ("a", False, "b") and "12.50 more than b" in sure["text"]


def test_names(spark):
    targets = spark.createDataFrame([("power_banks", "Power Banks", "category", 0, ["power bank", "portable charger"]), ("audio", "Audio", "category", 1, ["earbuds"])], "code string, label string, kind string, place int, names array<string>")
    aliases = names.alias_dim(targets)
    typed = ["Power-Bank!!", "powerbanks", "what do power banks cost", "earbud", "erbuds", "my portable charger x", "zzzz", " ", None, "Power-Bank!!"]
    df = spark.createDataFrame([(t,) for t in typed], "query string")
    got = {r["typed"]: (r["code"], r["how"], r["certain"]) for r in names.resolve_names(df, aliases).collect()}
    assert got["Power-Bank!!"] == ("power_banks", "exact", True) and got["powerbanks"][:2] == ("power_banks", "alias")
    assert got["what do power banks cost"][:2] == ("power_banks", "exact") and got["earbud"][:2] == ("audio", "alias")
    assert got["erbuds"] == ("audio", "fuzzy", False) and got["my portable charger x"][:2] == ("power_banks", "partial") and "zzzz" not in got
    near = names.suggest_names(spark.createDataFrame([("audoi",)], "query string"), aliases).collect()
    assert near[0]["code"] == "audio"


def test_questions(spark):
    cases = {
        "what margin can I expect on phone cases": ("margin", None, "cases", None),
        "what sells best in Nairobi": ("unknown", "sales volume", None, None),
        "is the earbuds category crowded": ("saturation", None, None, None),
        "where is there room in the market": ("opportunity", None, None, None),
        "price of a phone case over the last 3 weeks": ("price_level", None, "cases", 21),
        "has the price gone up since june": ("trend", None, None, 90),
        "  ": ("unknown", "empty", None, None),
        "hello": ("unknown", "not understood", None, None),
    }
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, question string")
    got = questions.route_questions(df, {"category_code": {"phones": ["phone"], "cases": ["phone case"]}}).orderBy("i").collect()
    assert [(r["intent"], r["refusal"], r["category_code"], r["window_days"]) for r in got] == list(cases.values())


def test_answers_carry_evidence_or_refuse(spark):
    rows = [listing(i, 2000 + 10 * i) for i in range(40)] + [listing(i, 5, category="thin") for i in range(3)]
    rolls = rollup.rollup(spark.createDataFrame(rows, LISTING))
    ask = [(0, "price", "c"), (1, "price", "thin"), (2, "price", None), (3, "price", "none"), (4, "how many sellers", "c"), (5, "price history", "c")]
    routed = questions.route_questions(spark.createDataFrame(ask, "id int, question string, category string"), {}).withColumn("category_code", F.col("category")).withColumn("platform_code", F.lit(None).cast("string"))
    trends = spark.createDataFrame([], "category_code string, platform_code string, available boolean, direction string, change_kes decimal(12,2), change_percent double, from_date date, to_date date")
    rates = spark.createDataFrame([], "category_code string, commission_rate decimal(5,4)")
    got = questions.answer_questions(routed, rolls, trends, rates, "id").orderBy("id").collect()
    assert [r["answered"] for r in got] == [True, False, False, False, True, False]
    assert "KSh 2195.00" in got[0]["text"] and "40 listings from 10 sellers on p" in got[0]["text"] and "too few" in got[1]["text"]


def test_answers_on_costs(spark):
    """Margins, coverage, comparison and costs: a rate holds on its own platform only, and what is missing is named."""
    policy = spark.createDataFrame([("a", "A", True, None, None, 14, [("return", "per_return", D(150))]), ("b", "B", False, D("0.05"), D("0.12"), 3, [])], POLICY)
    rates = spark.createDataFrame([("c", D("0.06")), ("e", D("0.06"))], "category_code string, commission_rate decimal(5,4)")
    delivery = spark.createDataFrame([("a", "x", D(100), D(60), 4, 2), ("b", "x", D(90), None, 0, 1), ("a", "y", None, None, 0, 0)], "platform_code string, county_code string, door_delivery decimal(12,2), pickup_station decimal(12,2), stations int, typical_days int")
    counties = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "county_code string, has_logistics boolean")
    rows = [listing(i, 1000) for i in range(40)] + [listing(i, 20, category="e", platform="b") for i in range(40)] + [listing(i, 90, category="cheap", platform="a") for i in range(40)]
    rolls = rollup.rollup(spark.createDataFrame(rows, LISTING).withColumn("platform_code", F.when(F.col("platform_code") == "p", "a").otherwise(F.col("platform_code"))))
    ask = [
        (0, "what margin", "c", None), (1, "what margin", "e", None), (2, "what margin", "c", "y"), (3, "do you deliver to", None, "x"), (4, "do you deliver to", None, "y"), (5, "do you deliver to", None, "z"),
        (6, "do you deliver to", None, "q"), (7, "do you deliver to", None, None), (8, "compare", "c", "x"), (9, "compare", None, "x"), (10, "total fees", None, "x"), (11, "total fees", "c", "q"), (12, "what commission", "e", None),
        (13, "compare", "thin", "x"),
    ]
    routed = questions.route_questions(spark.createDataFrame(ask, "id int, question string, category_code string, county_code string"), {}).withColumn("platform_code", F.lit(None).cast("string"))
    trends = spark.createDataFrame([], "category_code string, platform_code string, available boolean, direction string, change_kes decimal(12,2), change_percent double, from_date date, to_date date")
    costly = questions.answer_costs(routed, rolls, policy, rates, delivery, counties, "id", "x", "a")
    got = {r["id"]: (r["answered"], r["text"]) for r in questions.answer_questions(routed, rolls, trends, rates, "id", policy, costly).collect()}
    assert len(got) == len(ask)
    # 1000 less 6 %, less 100 to the door, less 30 %: 540
    assert got[0][0] and "After 6.0% commission and KSh 100.00 delivery to x, a landed cost under KSh 540.00 keeps a 30% margin." in got[0][1] and "40 listings" in got[0][1]
    assert got[1] == (False, "not known: category commission rate") and got[2] == (False, "not known: last mile cost for this county")
    assert got[3] == (True, "Door delivery to x by a costs KSh 100.00, or KSh 60.00 to one of 4 pickup stations, in 2 days as a rule.")
    assert got[4][0] and "no published delivery figure" in got[4][1] and got[5][0] and "no confirmed logistics" in got[5][1]
    assert got[6] == (False, "unknown county") and got[7] == (False, "no county named")
    # a keeps 1000 - 60 - 100 - 7.50 = 832.50; b has no listings of c
    assert got[8] == (True, "In x: a leaves the most: KSh 832.50 of a KSh 1000.00 sale. Not included, for lack of figures: b.")
    assert got[9] == (False, "no category named") and got[13] == (False, "no listings collected")
    # at the usual price without a category, a has no rate and no band; b keeps 1000 - 85 - 90
    assert got[10] == (True, "In x: b leaves the most: KSh 825.00 of a KSh 1000.00 sale. Not included, for lack of figures: a.")
    assert got[11] == (False, "not comparable yet") and got[12] == (False, "no figure for this question")


def test_metrics_by_day_and_origins(spark):
    log = spark.createDataFrame([("margin", None, True, 1), ("margin", "x", False, 1), ("margin", None, False, 2)], "intent string, refusal string, answered boolean, day int")
    assert sorted(map(tuple, questions.question_metrics(log, "day").collect())) == [("margin", 1, 2, 1, 1, 0.5), ("margin", 2, 1, 1, 0, 1.0)]
    policy = spark.createDataFrame([("p", "P", 7, None, None, "schedule", DAY)], "platform_code string, name string, payout_days int, return_window_days int, requirements array<string>, source string, read date")
    got = {r["topic"]: (r["fact"], r["confirmed"], r["source"], r["read"]) for r in costs.policy_facts(policy).collect()}
    assert got["payout"] == ("7 day cycle", True, "schedule", DAY) and got["returns"][:2] == ("not confirmed", False)


LD = '<script type="application/ld+json">{}</script>'


def test_product_pages(spark):
    product = '{"@type":"Product","name":"Power Bank","sku":"AB 1","brand":{"name":"Oraimo"},"offers":{"price":"1,299","priceCurrency":"KES","availability":"http://schema.org/InStock","seller":{"name":"Shop"}},"aggregateRating":{"ratingValue":"4.5","reviewCount":12}}'
    html = [
        LD.format(product),
        LD.format('{"@graph":[{"@type":"WebPage"},' + product + "]}"),
        LD.format("[1,") + '<meta property="og:title" content="Plain &amp; simple"><span data-price="KSh 500">',
        "<h1>Just a moment</h1> checking your browser <b data-price='1'>",
        LD.format(product.replace("1,299", "none")),
        LD.format(product.replace("KES", "USD")),
        None,
    ]
    df = spark.createDataFrame([(f"u{i}", h, DAY) for i, h in enumerate(html)], "url string, html string, fetched_on date")
    got = {r["source_url"]: r for r in pages.extract_products(df, "p").collect()}
    assert set(got) == {"u0", "u1", "u2"}
    assert (got["u0"]["title"], got["u0"]["price_kes"], got["u0"]["source_key"], got["u0"]["in_stock"], got["u0"]["seller_name"], got["u0"]["rating_count"]) == ("Power Bank", 1299, "p:ab-1", True, "Shop", 12)
    assert got["u1"]["brand"] == "Oraimo" and (got["u2"]["title"], got["u2"]["price_kes"]) == ("Plain & simple", 500)


def test_cards_and_breadcrumb(spark):
    card = '<article class="prd _fb"><a href="/x-{0}.html" data-sku="S{0}"><h3 class="name">Thing &quot;{0}&quot;</h3><div class="prc">KSh {1}</div></a></article>'
    html = "<nav><a>Home</a><a>Phones</a><a><b>Cases</b></a></nav>" + card.format(1, 100) + card.format(2, "none") + card.format(1, 300)
    df = spark.createDataFrame([("u", html, DAY)], "url string, html string, fetched_on date")
    got = pages.extract_cards(df, "p").collect()
    assert [(r["title"], r["price_kes"], r["source_key"]) for r in got] == [('Thing "1"', 100, "p:s1")]
    assert df.select(pages.nav_breadcrumb(F.col("html"))).first()[0] == "Phones > Cases"


def test_urls(spark):
    rules = {"allowed_paths": ["/*.html", "/catalog/ok/"], "disallowed_prefixes": ["/en/", "/catalog/"], "disallowed_fragments": ["/seller/"], "disallow_query_strings": True}
    urls = {"https://a/x.html": True, "https://a/x.html?c=1": False, "https://a/en/x": False, "https://a/catalog/ok/1": True, "https://a/catalog/no": False, "https://a/b/seller/x": False, "https://a": True}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in df.select("url", pages.url_allowed(F.col("url"), rules)).collect()} == urls
    maps = spark.createDataFrame([("a-other", "<loc>https://a/1.html</loc>"), ("product-1", "<loc> https://a/2.html </loc><loc>https://a/seller/</loc>"), ("brand", "<loc>https://a/3.html</loc>")], "name string, content string")
    assert [r["url"] for r in pages.sitemap_urls(maps, rules, 5).collect()] == ["https://a/2.html", "https://a/1.html"]


def test_entitled_rows(spark):
    rows = spark.createDataFrame([("a", DAY), ("a", DAY - dt.timedelta(40)), ("b", DAY)], "platform_code string, observed_on date")
    accounts = spark.createDataFrame([("u", "free", True), ("v", "pro", True), ("w", "pro", False)], "account_ref string, tier string, active boolean")
    tiers = spark.createDataFrame([("free", ["a"], 30), ("pro", ["a", "b"], None)], "tier string, platforms array<string>, history_days int")
    got = access.entitled_rows(rows, accounts, tiers, F.lit(DAY)).groupBy("account_ref").count().collect()
    assert {r[0]: r[1] for r in got} == {"u": 1, "v": 3}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(*listing(i % 5, 10 + i), i) for i in range(20)]
    schema = LISTING + ", at int"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        ingest.ingest_exact(stream, str(tmp_path / "store"), str(tmp_path / "ckpt"), ["at"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 5
    daily.price_histogram(stream, str(tmp_path / "hist"), str(tmp_path / "ckpt2")).awaitTermination()
    hist = spark.read.parquet(str(tmp_path / "hist"))
    assert hist.agg(F.sum("n")).first()[0] == 20


def test_examples_nearest_the_middle(spark):
    rows = [(*listing(i, 100 * i), f"u{i}", "t" * 100, i) for i in range(1, 10)]
    df = spark.createDataFrame(rows, LISTING + ", source_url string, title string, at int")
    got = rollup.example_listings(df, ["at"]).orderBy("rank").collect()
    assert [int(r["price_kes"]) for r in got] == [500, 400, 600] and len(got[0]["title"]) == 90


@pytest.mark.parametrize("n", [2, 5])
def test_partitions_do_not_change_the_rollup(spark, n):
    rows = spark.createDataFrame([listing(i, 7 * i % 97 + 1) for i in range(60)], LISTING)
    assert rollup.rollup(rows.repartition(n)).collect() == rollup.rollup(rows).collect()


def test_item_pages(spark):
    item = '<div class="c product-item"><a href="/i-{0}"><!--f--><p class="product-title">Nice thing {0}</p><b class="product-price">KSh {1}</b></a>'
    html = item.format(1, 500) + item.format(2, "soon") + item.format(1, 700) + item.format(3, 90)
    got = pages.extract_items(spark.createDataFrame([("u", html, DAY)], "url string, html string, fetched_on date"), "p").orderBy("source_key").collect()
    assert [(r["title"], int(r["price_kes"]), r["source_key"]) for r in got] == [("Nice thing 1", 500, "p:i-1"), ("Nice thing 3", 90, "p:i-3")]


def test_dims_and_taxonomy(spark, tmp_path):
    from stallwise.sources import dims

    for name in dims.SCHEMAS:
        (tmp_path / f"{name}.jsonl").write_text("")
    (tmp_path / "category.jsonl").write_text('{"code":"audio","name":"Audio","commission_rate":0.11,"keywords":["earbud"]}\n')
    (tmp_path / "rule.jsonl").write_text('{"kind":"accessory","word":"charger","owner":"power"}\n{"kind":"qualified","word":"case for","owner":"phone","requires":["tecno"]}\n')
    d = dims.load_dims(spark, str(tmp_path))
    rules = dims.taxonomy(d["category"], d["rule"])
    assert rules.keywords == {"audio": ["earbud"]} and rules.accessory_markers == {"charger": "power"} and rules.qualified_markers == [("case for", "phone", ["tecno"])]
    assert d["county"].count() == 0


def test_catalogue_answers(spark):
    ranked = spark.createDataFrame([("phone_cases", "p", 9.5, 2.0), ("audio", "p", 12.0, 3.0)], "category_code string, platform_code string, activity_score double, listings_per_seller double")
    facts = spark.createDataFrame([("p", "P", "payout", "7 day cycle", True)], "platform_code string, platform_name string, topic string, fact string, confirmed boolean")
    asked = spark.createDataFrame([(0, "what is most popular"), (1, "where is there room"), (2, "when do i get paid"), (3, "refund policy")], "id int, question string")
    routed = questions.route_questions(asked, {"platform_code": {}})
    got = [r["text"] for r in questions.catalogue_answers(routed, ranked, ranked, facts, "p").orderBy("id").collect()]
    assert got[0].startswith("Most sellers list: audio on p, phone cases on p.") and got[1] == "Fewest listings a seller: phone cases on p, audio on p." and got[2] == "P: 7 day cycle." and got[3] is None
    delivery = spark.createDataFrame([("p", "x", D(145))], "platform_code string, county_code string, door_delivery decimal(12,2)")
    routed = routed.filter("id < 2").withColumn("county_code", F.when(F.col("id") == 0, "x"))
    got = [r["text"] for r in questions.catalogue_answers(routed, ranked, ranked, facts, "p", delivery).orderBy("id").collect()]
    assert got[0].endswith("delivery to x costs KSh 145.00.") and "delivery" not in got[1]


def test_rollups_are_replaced_by_day(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = spark.createDataFrame([(DAY, 1), (DAY + dt.timedelta(1), 2)], "observed_on date, n int")
    store.write_rollup(rows, path)
    store.write_rollup(rows.filter("n = 1").withColumn("n", F.lit(5)), path)
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [2, 5]


def test_near_names_miss_no_pair_within_the_budget(spark):
    """Against all pairs, with words of every length around the budgets' steps."""
    import random

    from stallwise.functions.text import typo_budget
    from stallwise.operators import names

    rnd = random.Random(4)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 11))) for _ in range(120)}
    for w in list(words)[:60]:
        at = rnd.randrange(len(w) + 1)
        words |= {w[:at] + "x" + w[at:], w[:at] + w[at + 1 :] or "z"}
    texts = spark.createDataFrame([(w, w) for w in words], "typed string, _text string")
    aliases = spark.createDataFrame([(w, w) for w in words], "code string, alias string")
    for budget in (typo_budget(F.col("alias")), F.greatest(typo_budget(F.col("alias")), F.lit(2))):
        d = F.levenshtein("_text", "alias")
        want = texts.crossJoin(aliases).filter(d <= budget).select("_text", "alias")
        got = names._near(texts, aliases, budget)
        assert got.count() == got.select("_text", "alias").distinct().count() < len(words) ** 2
        assert want.join(got, ["_text", "alias"], "left_anti").count() == 0 and want.count() > len(words)


def test_entities_and_challenge_pages(spark):
    from stallwise.sources import pages

    given = "a &amp;&lt;b&gt; &eacute;&#233;&#xE9; &copy; &hellip; &nosuch; &#0; AT&T &#128512;"
    df = spark.createDataFrame([(given, "verify you are human"), ("plain", "Captcha" + "x" * 900), (None, None)], "t string, html string")
    got = df.select(pages.decode_entities(F.col("t")), pages.blocked_page(F.col("html")), pages.blocked_page(F.col("html"), short_only=True)).collect()
    assert got[0][0] == "a &<b> ééé © … &nosuch; &#0; AT&T 😀" and got[1][0] == "plain" and got[2][0] is None
    assert [tuple(r[1:]) for r in got] == [(False, True), (True, False), (None, None)]


def test_product_pages_sellers_and_breadcrumbs(spark):
    import datetime
    import json

    from stallwise.sources import pages

    def page(**more):
        product = {"@type": "Product", "name": "Lamp", "sku": "1", "offers": {"price": "500"}} | more
        crumbs = {"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"position": 2}, {"name": "Lamps"}]}
        return f'<script type="application/ld+json">{json.dumps([crumbs])}</script><script type="application/ld+json">{json.dumps({"@graph": [product]})}</script>'

    day = datetime.date(2026, 1, 1)
    rows = [("u1", page(brand="Shiny"), day), ("u2", page(brand={"name": "Own Shop"}), day), ("u3", page(brand="Shiny", offers=[{"price": "7,000", "seller": {"name": "S"}}]), day), ("u4", "<h1>x</h1>", day), ("u5", None, day)]
    out = pages.extract_products(spark.createDataFrame(rows, "url string, html string, fetched_on date"), "web", own_brand="own shop").collect()
    assert {r["source_url"]: (r["seller_name"], r["breadcrumb"], int(r["price_kes"])) for r in out} == {
        "u1": ("Shiny", "Home > Lamps", 500), "u2": (None, "Home > Lamps", 500), "u3": ("S", "Home > Lamps", 7000)
    }
