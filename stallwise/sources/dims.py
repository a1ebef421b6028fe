"""Loading the dimensions from JSON lines, one file a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.operators.classify import Taxonomy

SCHEMAS = {
    "category": "code STRING, name STRING, commission_rate DECIMAL(5,4), commission_src STRING, commission_read DATE, keywords ARRAY<STRING>",
    "rule": "kind STRING, word STRING, owner STRING, requires ARRAY<STRING>",
    "platform": "platform_code STRING, name STRING, granularity STRING, active BOOLEAN, base_url STRING, caveat STRING",
    "policy": "platform_code STRING, name STRING, source STRING, source_url STRING, read DATE, per_category_rates_apply BOOLEAN, range_low DECIMAL(5,4), "
    "range_high DECIMAL(5,4), payout_days INT, return_window_days INT, requirements ARRAY<STRING>, fees ARRAY<STRUCT<name: STRING, basis: STRING, value: DECIMAL(12,2)>>",
    "county": "county_code STRING, name STRING, tier INT, has_logistics BOOLEAN, wards ARRAY<STRUCT<code: STRING, name: STRING, note: STRING>>",
    "delivery": "platform_code STRING, county_code STRING, door_delivery DECIMAL(12,2), pickup_station DECIMAL(12,2), stations INT, typical_days INT, read DATE, source STRING",
    "country": "country_code STRING, kind STRING, platforms ARRAY<STRING>, currency STRING, symbol STRING",
}


def load_dims(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The dimensions of ``folder`` by name, each from ``<name>.jsonl`` with its own schema; a bad line fails the read."""
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}.jsonl") for name, schema in SCHEMAS.items()}


def taxonomy(categories: DataFrame, rules: DataFrame) -> Taxonomy:
    """The classification rules from their two dimensions, which are hundreds of rows."""
    by_kind: dict[str, list] = {}
    for r in rules.orderBy("kind", "word").collect():
        by_kind.setdefault(r["kind"], []).append(r)
    return Taxonomy(
        keywords={r["code"]: r["keywords"] for r in categories.filter(F.size("keywords") > 0).collect()},
        accessory_markers={r["word"]: r["owner"] for r in by_kind.get("accessory", [])},
        qualified_markers=[(r["word"], r["owner"], r["requires"]) for r in by_kind.get("qualified", [])],
        guard_exempt=[r["word"] for r in by_kind.get("exempt", [])],
        condition_overrides=[r["word"] for r in by_kind.get("condition", [])],
        service_markers=[r["word"] for r in by_kind.get("service", [])],
    )
