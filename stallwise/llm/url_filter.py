"""URL filters: listed rules first, then a path-template tree judged by labelled purity.

The urls that a rule decides are the labelled ones. Their counts are kept by host
and path shape (runs of digits become ``0``). Walking down a host's tree, a
segment seen on fewer than ``min_support`` pages under its parent becomes the
wildcard ``*``; what lies below ``depth`` segments becomes ``**``. Sibling
templates of a host are ordered by their share of blocked labels, and neighbours
whose shares do not differ at the 5 % level (two-proportion z-test) are merged.
A template's purity is its branch's blocked share, smoothed by ``strength``
pseudo-pages at the share the same template has over all hosts, which itself is
smoothed by the overall share. A purity of ``threshold`` or more is rejected.

Null urls and urls without ``://`` have an empty host and path; they are judged
like the other urls of the empty template. Repeated rows are judged one by one.
Columns called like a result column are replaced; others may have any name. An empty
table gives an empty result. Very long urls are split like others, and what lies below
``depth`` segments is one template. Siblings of equal shares are ordered by their template.

A host, a shape or a template may be that of most urls: the facts of such keys (at most
1,024 a join) are broadcast, and their rows are dealt evenly. The sibling templates of one
parent, each of ``min_support`` pages or more, are ordered in one task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.joins import with_facts
from stallwise.session import cut_lineage

#: |z| above which two shares differ at the 5 % level.
Z = 1.96


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the ``(verdict, rule)`` that fits, and its verdict; null if none fits."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rule_path)
        best, verdict = F.when(fits, rule).otherwise(best), F.when(fits, decision).otherwise(verdict)
    return best, verdict


def templates(shapes: DataFrame, min_support: int, depth: int, total: int) -> DataFrame:
    """The ``total`` ``shapes`` (host, shape, n) with ``parent`` and ``template``, level by level from the root."""
    out = shapes.withColumn("_segments", F.filter(F.split("shape", "/"), lambda s: s != "")).withColumns(
        {"parent": F.lit(""), "template": F.lit("")}
    )
    for level in range(1, depth + 1):
        segment = F.get("_segments", F.lit(level - 1))
        out = out.withColumn("_segment", segment)
        support = out.groupBy("host", "template", "_segment").agg(F.sum("n").alias("_support"), F.count("*").alias("_rows"))
        support = support.filter((F.col("_support") >= min_support) & F.col("_segment").isNotNull())
        out = cut_lineage(
            with_facts(out, support, ["host", "template", "_segment"], total, ["host", "shape"])
            .withColumn("_segment", F.when(F.col("_segment").isNull() | F.col("_support").isNotNull(), F.col("_segment")).otherwise("*"))
            .withColumn("parent", F.when(F.col("_segment").isNull(), F.col("parent")).otherwise(F.col("template")))
            .withColumn("template", F.concat("template", F.coalesce(F.concat(F.lit("/"), "_segment"), F.lit(""))))
            .drop("_segment", "_support")
        )
    more = F.size("_segments") > depth
    return (
        out.withColumn("parent", F.when(more, F.col("template")).otherwise(F.col("parent")))
        .withColumn("template", F.when(more, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
        .drop("_segments")
    )


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    url: str = "url",
    min_support: int = 5,
    depth: int = 4,
    strength: float = 4.0,
    threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template``, ``purity`` and ``verdict``."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "template", "purity", "verdict")]
    host, path = split_url(F.col(url))
    # what tells a page from others of its url, as far as it can be hashed
    hashed = [F.col(f"`{c}`") for c, kind in pages.dtypes if c in own and not any(k in kind for k in ("map<", "variant"))]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_page"), F.xxhash64(*hashed).alias("_key"), host.alias("host"), path.alias("path"))
    rule, decision = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_decision": decision, "shape": F.regexp_replace("path", "[0-9]+", "0")})
    shapes = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_decision") == "block").alias("blocked"),
        F.count_if(F.col("_decision").isNotNull()).alias("labelled"),
    )
    shapes = cut_lineage(shapes)
    n_shapes, n_pages = shapes.agg(F.count("*"), F.sum("n")).first()
    tree = templates(shapes, min_support, depth, n_shapes)
    nodes = cut_lineage(
        tree.groupBy("host", "parent", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.count("*").alias("_rows"))
    )

    # merge neighbouring siblings whose shares do not differ
    siblings = Window.partitionBy("host", "parent").orderBy("_share", "template")
    seen = nodes.filter("labelled > 0").withColumn("_share", F.col("blocked") / F.col("labelled"))
    b0, n0 = F.lag("blocked").over(siblings), F.lag("labelled").over(siblings)
    seen = seen.withColumns({"_b0": b0, "_n0": n0})
    pooled = (F.col("blocked") + F.col("_b0")) / (F.col("labelled") + F.col("_n0"))
    spread = pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("_n0"))
    gap = F.col("_share") - F.col("_b0") / F.col("_n0")
    seen = seen.withColumn("_differs", F.when(gap * gap > Z * Z * spread, 1).otherwise(0))
    seen = seen.withColumn("_branch", F.sum("_differs").over(siblings.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    branch = Window.partitionBy("host", "parent", "_branch")
    seen = seen.select(
        "host", "template", F.sum("blocked").over(branch).alias("branch_blocked"), F.sum("labelled").over(branch).alias("branch_labelled")
    )

    overall = nodes.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("_overall"))
    any_host = nodes.groupBy("template").agg(F.sum("blocked").alias("_any_blocked"), F.sum("labelled").alias("_any_labelled"), F.count("*").alias("_rows"))
    any_host = any_host.join(F.broadcast(overall)).select(
        "template", "_rows", ((F.col("_any_blocked") + strength * F.col("_overall")) / (F.col("_any_labelled") + strength)).alias("_prior")
    )
    purity = (F.coalesce("branch_blocked", F.lit(0)) + strength * F.col("_prior")) / (F.coalesce("branch_labelled", F.lit(0)) + strength)
    priors = with_facts(nodes.select("host", "template", "_rows"), any_host, ["template"], n_shapes, ["host", "template"])
    pure = cut_lineage(priors.join(seen, ["host", "template"], "left").select("host", "template", "_rows", purity.alias("purity")))
    judged = with_facts(tree.select("host", "shape", "template", F.col("n").alias("_n")), pure, ["host", "template"], n_shapes, ["host", "shape"])
    judged = cut_lineage(judged.withColumnRenamed("_n", "_rows"))
    verdict = F.coalesce("_decision", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    rows = with_facts(rows, judged, ["host", "shape"], n_pages or 0, ["path", "_key"])
    return rows.select("_page.*", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
