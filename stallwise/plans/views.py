"""The driver's tables seen as the engine's inputs, and the small dimensions used with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators.classify import Taxonomy
from stallwise.session import table

LISTING_SQL = """
SELECT l.l_linestatus AS platform_code, concat(l.l_linestatus, ':', l.l_partkey) AS source_key, p.p_type AS category_code,
       p.p_name AS title, p.p_brand AS brand, s.s_name AS seller_name,
       CAST(l.l_extendedprice AS DECIMAL(12,2)) AS price_kes, CAST(p.p_retailprice AS DECIMAL(12,2)) AS was_price_kes,
       CAST(l.l_shipdate AS DATE) AS observed_on, l.l_orderkey, l.l_linenumber, l.l_returnflag
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""
EVENT_SQL = """
SELECT event_type AS category_code, 'web' AS platform_code, CAST(ts AS DATE) AS observed_on,
       CAST(value AS DECIMAL(12,2)) AS price_kes, CAST(user_id AS VARCHAR) AS seller_name
FROM events WHERE value IS NOT NULL
"""

#: Nouns of the part names by category; a part name is adjectives and nouns.
TAXONOMY = Taxonomy(
    keywords={
        "fasteners": ["bolt", "ring", "rod"],
        "gadgets": ["widget", "gizmo", "small widget"],
        "heavy": ["anvil", "plate", "gear"],
        "used": ["old anvil", "old gear"],
    },
    accessory_markers={"red ring": "gadgets", "hot plate": "gadgets"},
    qualified_markers=[("cold", "fasteners", ["rod", "bolt"])],
    guard_exempt=["fasteners"],
    condition_overrides=["used"],
    service_markers=["large rod"],
)
URL_RULES = {
    "allowed_paths": ["/*.html", "/en/7"],
    "disallowed_prefixes": ["/es/", "/en/1"],
    "disallowed_fragments": ["/99"],
    "disallow_query_strings": True,
}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_linestatus").alias("platform_code"),
        F.concat("l_linestatus", F.lit(":"), F.col("l_partkey").cast("string")).alias("source_key"),
        F.col("p_type").alias("category_code"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("s_name").alias("seller_name"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price_kes"), F.col("p_retailprice").cast("decimal(12,2)").alias("was_price_kes"),
        F.col("l_shipdate").cast("date").alias("observed_on"), "l_orderkey", "l_linenumber", "l_returnflag",
    )


def event_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select(
        F.col("event_type").alias("category_code"), F.lit("web").alias("platform_code"), F.col("ts").cast("date").alias("observed_on"),
        F.col("value").cast("decimal(12,2)").alias("price_kes"), F.col("user_id").cast("string").alias("seller_name"),
    )


def policy(spark: SparkSession) -> DataFrame:
    """Terms of the two line statuses as platforms: O has its own schedule and all fees, F a band and an unknown return fee."""
    return spark.sql(
        """
        SELECT * FROM VALUES
          ('O', 'Open Market', true, CAST(0.06 AS DECIMAL(5,4)), CAST(0.20 AS DECIMAL(5,4)), 7, 14, array('licence', 'bank account'),
           array(named_struct('name', 'return handling', 'basis', 'per_return', 'value', CAST(150 AS DECIMAL(12,2))),
                 named_struct('name', 'storage', 'basis', 'per_unit_per_month', 'value', CAST(20 AS DECIMAL(12,2))))),
          ('F', 'Fixed House', false, CAST(0.05 AS DECIMAL(5,4)), CAST(0.12 AS DECIMAL(5,4)), 3, CAST(NULL AS INT), CAST(NULL AS ARRAY<STRING>),
           array(named_struct('name', 'return handling', 'basis', 'per_return', 'value', CAST(NULL AS DECIMAL(12,2))),
                 named_struct('name', 'listing', 'basis', 'once', 'value', CAST(99 AS DECIMAL(12,2)))))
        AS t(platform_code, name, per_category_rates_apply, range_low, range_high, payout_days, return_window_days, requirements, fees)
        """
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published rate for each category but the last by name, from the categories' average part size."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category_code")).agg(F.floor(F.avg("p_size")).cast("int").alias("_s"))
    last = sizes.agg(F.max("category_code").alias("_last"))
    rated = sizes.join(F.broadcast(last)).filter("category_code <> _last")
    return rated.select("category_code", (F.col("_s") / 200).cast("decimal(5,4)").alias("commission_rate"))


RATES_SQL = """
SELECT p_type AS category_code, CAST(CAST(floor(avg(p_size)) AS INTEGER) / 200.0 AS DECIMAL(5,4)) AS commission_rate
FROM part GROUP BY p_type HAVING p_type <> (SELECT max(p_type) FROM part)
"""


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door delivery by platform and nation: 90 and the nation's key shillings, none to nations of region 4 on F."""
    nation = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey")
    both = nation.withColumn("platform_code", F.explode(F.array(F.lit("O"), F.lit("F"))))
    fee = F.when(~((F.col("platform_code") == "F") & (F.col("n_regionkey") == 4)), (F.col("n_nationkey") + 90).cast("decimal(12,2)"))
    return both.select("platform_code", F.col("n_name").alias("county_code"), fee.alias("door_delivery"))


DELIVERY_SQL = """
SELECT p.platform_code, n_name AS county_code,
       CASE WHEN NOT (p.platform_code = 'F' AND n_regionkey = 4) THEN CAST(n_nationkey + 90 AS DECIMAL(12,2)) END AS door_delivery
FROM nation, (VALUES ('O'), ('F')) p(platform_code)
"""


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (category, platform, county), each a small dimension."""
    categories = table(spark, sf_dir, "part").select(F.col("p_type").alias("category_code")).distinct()
    return categories.crossJoin(delivery(spark, sf_dir).select("platform_code", "county_code"))


#: Names under which questions mention categories, platforms and counties.
VOCABULARIES = {
    "category_code": {"bolts": ["bolt", "steel bolt"], "gears": ["gear", "the gear"], "data": ["data", "text", "table"]},
    "platform_code": {"O": ["open market", "example"], "F": ["fixed house", "page"]},
    "county_code": {"n1": ["paris", "france"], "n2": ["berlin", "city"]},
}
