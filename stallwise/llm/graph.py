"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``links`` (``x``, ``y``).

    Each round takes the smallest label among a node and its neighbours and then the
    label of that label, so chains shorten by more than half. Labels stay distributed;
    the driver sees one count a round.
    """
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        step = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("x").alias("new"), F.col("label").alias("further"))
        moved = step.join(jump, "new", "left").select("x", "old", F.least("new", "further").alias("label"))
        moved = cut_lineage(moved)
        changed = moved.filter("old <> label").count()
        labels = moved.select("x", "label")
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """What ``components`` gives when ``links`` are added to those that gave ``labels``.

    Only links between different components are walked, so with few or none of them there
    are few rounds or none, and the driver keeps the plans of as many jobs less.
    """
    for side in ("x", "y"):
        own = labels.select(F.col("node").alias(side), F.col("component").alias("_known"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_known", side)).drop("_known")
    between = cut_lineage(links.filter("x <> y").select("x", "y"))
    if between.isEmpty():
        return labels
    merged = components(between)
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    moved = labels.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return cut_lineage(moved.unionByName(merged.join(labels, "node", "left_anti")))
