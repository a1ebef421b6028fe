"""Rule-based categories of listings; one projection, no shuffle.

The rules are data: a ``Taxonomy`` holds keywords by category, accessory markers
with the category that owns them, markers that need a context, exempt categories,
categories of condition that win over product types, and words of services.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.text import clean_title
from stallwise.session import path_exists


@dataclass
class Taxonomy:
    keywords: dict[str, list[str]]
    accessory_markers: dict[str, str] = field(default_factory=dict)
    qualified_markers: list[tuple[str, str, list[str]]] = field(default_factory=list)
    guard_exempt: list[str] = field(default_factory=list)
    condition_overrides: list[str] = field(default_factory=list)
    service_markers: list[str] = field(default_factory=list)


def any_word(words: list[str], suffix: str = "") -> str:
    """A pattern for any of the words as a whole, the longest tried first."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    return r"(?i)\b(" + "|".join(re.escape(w) for w in ordered) + r")" + suffix + r"\b"


def enrich(listings: DataFrame, rules: Taxonomy, title: str = "title", breadcrumb: str | None = "breadcrumb") -> DataFrame:
    """``listings`` with ``category_code``, ``all_matches``, ``hit_count``, ``is_service``, ``confidence``, ``classified_by`` and ``aggregatable``."""
    crumb = F.lower(F.col(breadcrumb)) if breadcrumb else F.lit(None).cast("string")
    rows = listings.withColumn("_blob", F.nullif(F.concat_ws(" ", clean_title(F.col(title)), F.nullif(crumb, F.lit(""))), F.lit("")))
    counted = [
        F.struct((-F.regexp_count("_blob", F.lit(any_word(words)))).alias("minus"), F.lit(code).alias("code"))
        for code, words in sorted(rules.keywords.items())
    ]
    none = F.array().cast("array<struct<minus:int,code:string>>")
    # most hits first, then by code
    ranked = F.array_sort(F.filter(F.array(*counted), lambda m: m["minus"] < 0)) if counted else none
    # the first marker found decides, also when it decides to leave the winner
    owner: Column = F.lit(None).cast("string")
    markers = [(F.col("_blob").rlike(rf"(?i)\b{re.escape(w)}s?\b"), o) for w, o in sorted(rules.accessory_markers.items(), key=lambda m: -len(m[0]))]
    markers += [(F.col("_blob").rlike(rf"(?i)\b{re.escape(w)}\b") & F.col("_blob").rlike(any_word(needs)), o) for w, o, needs in rules.qualified_markers]
    for found, o in reversed(markers):
        owner = F.when(found, F.lit(o)).otherwise(owner)
    service = F.coalesce(F.col("_blob").rlike(any_word(rules.service_markers)), F.lit(False)) if rules.service_markers else F.lit(False)
    rows = _once(rows, "_m", F.struct(F.coalesce(ranked, none).alias("ranked"), owner.alias("owner"), service.alias("service")))

    first = F.get("_m.ranked", F.lit(0))
    override = F.get(F.filter("_m.ranked", lambda m: m["code"].isin(rules.condition_overrides)), F.lit(0)) if rules.condition_overrides else first
    won = F.coalesce(override, first)
    contested = (F.size("_m.ranked") > 1) & (first["minus"] == F.get("_m.ranked", F.lit(1))["minus"])
    rows = _once(
        rows,
        "_w",
        F.struct(
            won["code"].alias("code"), F.coalesce(-won["minus"], F.lit(0)).alias("hits"), contested.alias("contested"),
            F.col("_m.ranked.code").alias("all"), F.col("_m.owner").alias("owner"), F.col("_m.service").alias("service"),
        ),
    )
    code, n, owner = F.col("_w.code"), F.col("_w.hits"), F.col("_w.owner")
    exempt = F.coalesce(code.isin(rules.guard_exempt), F.lit(False)) if rules.guard_exempt else F.lit(False)
    moved = owner.isNotNull() & ~exempt & ~(code.isNotNull() & (n >= 2)) & ~owner.eqNullSafe(code)
    rescued = moved & code.isNull()
    is_service = F.col("_w.service") & code.isNotNull()
    confidence = (
        F.when(rescued, "medium")
        .when(code.isNull(), "none")
        .when(is_service, "low")
        .when(moved | F.col("_w.contested") | (n < 2), "medium")
        .otherwise("high")
    )
    result = F.struct(
        F.when(moved, owner).otherwise(code).alias("category_code"),
        F.col("_w.all").alias("all_matches"),
        F.when(rescued, 1).otherwise(n).alias("hit_count"),
        is_service.alias("is_service"),
        confidence.alias("confidence"),
        F.when(moved, "accessory_guard").when(code.isNotNull(), "keyword").alias("classified_by"),
    )
    out = _once(rows, "_r", result)
    fit = F.col("_r.category_code").isNotNull() & F.col("_r.confidence").isin("high", "medium") & ~F.col("_r.is_service")
    added = ("category_code", "all_matches", "hit_count", "is_service", "confidence", "classified_by")
    kept = [c for c in listings.columns if c not in (*added, "aggregatable")]
    return out.select(*kept, *[F.col(f"_r.{c}").alias(c) for c in added], fit.alias("aggregatable"))


class TitleDictionary:
    """The categories of titles seen so far, kept under the hash of the rules that gave them.

    A market has many listings of few titles: ``learn`` classifies each distinct title (with
    its breadcrumb) once, ``enrich`` joins. Other rules have another hash and so another
    dictionary; rules that come back find theirs again.
    """

    def __init__(self, path: str, rules: Taxonomy, title: str = "title", breadcrumb: str | None = "breadcrumb") -> None:
        self.rules, self.title, self.breadcrumb = rules, title, breadcrumb
        self.path = f"{path}/rules={rules_hash(rules)}"

    def _keys(self, rows: DataFrame) -> dict[str, Column]:
        return {"_title": F.col(self.title), "_crumb": F.col(self.breadcrumb) if self.breadcrumb else F.lit(None).cast("string")}

    def known(self, spark: SparkSession) -> DataFrame | None:
        return spark.read.parquet(self.path) if path_exists(spark, self.path) else None

    def learn(self, rows: DataFrame) -> None:
        """Classify the titles of ``rows`` that are not known yet."""
        titles = rows.withColumns(self._keys(rows)).select("_title", "_crumb").distinct()
        known = self.known(rows.sparkSession)
        if known is not None:
            both = [titles[c].eqNullSafe(known[c]) for c in ("_title", "_crumb")]
            titles = titles.join(known, both, "left_anti")
        enrich(titles, self.rules, "_title", "_crumb").write.mode("append").parquet(self.path)

    def enrich(self, listings: DataFrame) -> DataFrame:
        """``listings`` as by ``enrich``; the rows of titles never learnt are left out, so ``learn`` from the listings, or from a table of all titles, before."""
        known = self.known(listings.sparkSession)
        added = [c for c in known.columns if c not in ("_title", "_crumb")]
        rows = listings.drop(*added).withColumns({f"_own{c}": v for c, v in self._keys(listings).items()})
        both = [rows[f"_own{c}"].eqNullSafe(known[c]) for c in ("_title", "_crumb")]
        return rows.join(known, both).drop("_title", "_crumb", "_own_title", "_own_crumb")


def rules_hash(rules: Taxonomy) -> str:
    """A name for the rules: equal rules have equal names, however their tables are ordered."""
    ordered = {k: sorted(v.items()) if isinstance(v, dict) else sorted(map(str, v)) for k, v in vars(rules).items()}
    ordered["keywords"] = [(k, sorted(v)) for k, v in ordered["keywords"]]
    # of equally long markers the first given decides, so their order is a part of the rules
    ordered["accessory_markers"], ordered["qualified_markers"] = list(rules.accessory_markers.items()), rules.qualified_markers
    return hashlib.sha256(json.dumps(ordered).encode()).hexdigest()[:16]


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row.

    A projection that is used several times, and filters above it, would have its
    patterns copied into each use; a generated column is not copied.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def commission(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """``listings`` with the published rate of their category, null where none is known."""
    return listings.join(rates.select("category_code", "commission_rate"), "category_code", "left")
