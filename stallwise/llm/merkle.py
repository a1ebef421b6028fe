"""A Merkle manifest of a dataset: leaves of rows, one tree a group, one over the groups, a proof for every row.

Rows of a group are ordered by their key and numbered over the cluster: one range
exchange, then each part's first number from the counts of the parts before it. Aligned
runs of ``fanout ** levels`` rows are the partitions of the tree. Each hashes its own
subtree. Then the partitions climb by a butterfly exchange: in round r those partitions
of an aligned group that agree in all base-``fanout`` digits of their number but the
r-th swap their subtree roots, and each of them hashes the ancestor for itself and notes
the others as a step of its proof. After the last round every partition holds the
group's root and all upper steps, so nothing is handed down. Numbers up to the next
power of ``fanout`` are ghosts: they hold no rows and take part in the swaps, so that a
partition next to an incomplete group still has a partner that knows that group's root.
The roots of the groups, ordered by the group's key, are the leaves of one more such tree.

A node without a neighbour in the last run of a level is hashed alone; a tree of one
leaf is that leaf. Null fields are part of a leaf as ``-``. A null group is a group, and
the first; a null key comes first in its group. Rows of one key are ordered by their
leaf, and repeated rows are leaves of their own. Texts are hashed where they are read and
never exchanged, so their length does not matter. An empty table gives an empty result.
The input may have columns of any name; only those in ``keep`` come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: the digests left and right of the node in its run, joined.
STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """The leaf of a row: each field as byte count, colon and value, or ``-`` for a null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their number ``_at`` within ``_group`` by ``_key`` and ``node``, and the group's ``_total``."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_group", "_key", "node"]
    rows = cut_lineage(nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy("_group", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_group", "_part", "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_group")).alias("_total"),
    )
    at = F.col("_before") + F.col("_id") - F.col("_first")
    return rows.join(counts, ["_group", "_part"]).select("_group", "_total", at.alias("_at"), "node", "_row")


def parents(nodes: str, fanout: int) -> Column:
    """The nodes above those of the column ``nodes``, one a run."""
    runs = F.sequence(F.lit(0), F.expr(f"(size({nodes}) - 1) div {fanout}"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, fanout), "")))


def subtrees(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row a partition of the tree: its rows, and the nodes of each level of its subtree."""
    size = fanout**levels
    member = F.struct((F.col("_at") % size).cast("int").alias("i"), "node", "_row")
    out = rows.groupBy("_group", F.expr(f"_at div {size}").alias("_block")).agg(
        F.first("_total").alias("_total"), F.array_sort(F.collect_list(member), lambda a, b: a["i"] - b["i"]).alias("_rows")
    )
    out = out.withColumn("_l0", F.col("_rows.node"))
    for j in range(levels):
        out = out.withColumn(f"_l{j + 1}", F.when(F.col("_total") > fanout**j, parents(f"_l{j}", fanout)).otherwise(F.col(f"_l{j}")))
    return out.select("_group", "_block", "_total", "_rows", F.array(*[f"_l{j}" for j in range(levels + 1)]).alias("_levels"))


def butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """The partitions' roots (``_group``, ``_block``, ``_count`` of the group, ``node``) after all rounds.

    ``node`` is then the group's root and ``steps`` lead from the partition's root to it.
    """
    most = roots.agg(F.max("_count")).first()[0] or 1
    rounds = 0
    while fanout**rounds < most:
        rounds += 1
    full = F.array_min(F.filter(F.array(*[F.lit(fanout**r) for r in range(rounds + 1)]), lambda p: p >= F.col("_count")))
    ghosts = roots.filter((F.col("_block") == 0) & (F.col("_count") < full)).select(
        "_group", F.explode(F.sequence(F.col("_count"), full - 1)).alias("_block"), "_count", F.lit(None).cast("string").alias("node")
    )
    out = roots.select("_group", "_block", "_count", "node").unionByName(ghosts).withColumn("steps", F.array().cast(STEPS))
    for r in range(rounds):
        step, digit = fanout**r, F.expr(f"(_block div {fanout**r}) % {fanout}")
        member = F.struct(digit.alias("digit"), "_block", "node", "steps")
        met = out.groupBy("_group", "_count", F.expr(f"_block div {step * fanout}").alias("_high"), (F.col("_block") % step).alias("_low")).agg(
            F.array_sort(F.collect_list(member), lambda a, b: (a["digit"] - b["digit"]).cast("int")).alias("_met")
        )
        each = met.select("_group", "_count", "_met", F.explode("_met").alias("_own"))
        join = lambda keep: F.array_join(F.transform(F.filter("_met", keep), lambda m: m["node"]), "")
        left, right = join(lambda m: m["digit"] < F.col("_own.digit")), join(lambda m: m["digit"] > F.col("_own.digit"))
        known = F.exists("_met", lambda m: m["node"].isNotNull())
        more = F.col("_count") > step
        out = each.select(
            "_group", F.col("_own._block").alias("_block"), "_count",
            F.when(more & known, digest(join(lambda m: F.lit(True)))).otherwise(F.col("_own.node")).alias("node"),
            F.when(more, F.concat("_own.steps", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("_own.steps")).alias("steps"),
        )
    return out.filter("_block < _count")


def climb(nodes: DataFrame, fanout: int, levels: int, grouped: bool) -> DataFrame:
    """``nodes`` (``_group``, ``_key``, ``node``, ``_row``) with ``steps`` to the ``root``, and the ``subroot`` of their group."""
    blocks = cut_lineage(subtrees(numbered(nodes), fanout, levels))
    count = F.ceil(F.col("_total") / fanout**levels).cast("long")
    roots = blocks.select("_group", "_block", count.alias("_count"), F.get(F.element_at("_levels", -1), F.lit(0)).alias("node"))
    upper = cut_lineage(butterfly(roots, fanout)).select("_group", "_block", F.col("node").alias("subroot"), F.col("steps").alias("_upper"))
    if grouped:
        tops = upper.filter("_block = 0").select(F.lit("").alias("_group"), F.col("_group").alias("_key"), F.col("subroot").alias("node"), F.struct("_group").alias("_row"))
        above = climb(tops, fanout, levels, grouped=False).select(F.col("_row._group").alias("_group"), "root", F.col("steps").alias("_more"))
        upper = upper.join(above, "_group").withColumn("_upper", F.concat("_upper", "_more")).drop("_more")
    else:
        upper = upper.withColumn("root", F.col("subroot"))
    one = F.col("_one")
    own = []
    for j in range(levels):
        n, at = F.expr(f"_one.i div {fanout**j}").cast("int"), F.expr(f"(_one.i div {fanout**j}) % {fanout}").cast("int")
        nodes_of = F.get("_levels", F.lit(j))
        left, right = F.slice(nodes_of, n - at + 1, at), F.slice(nodes_of, n + 2, fanout - 1 - at)
        own.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    climbed = sum((F.col("_total") > fanout**j).cast("int") for j in range(levels))
    rows = blocks.join(upper, ["_group", "_block"]).withColumn("_one", F.explode("_rows"))
    steps = F.concat(F.slice(F.array(*own), F.lit(1), climbed), "_upper")
    return rows.select(one["_row"].alias("_row"), one["node"].alias("node"), steps.alias("steps"), "subroot", "root")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, keep: tuple[Column, ...] = (), fanout: int = 2, levels: int = 10) -> DataFrame:
    """A row's ``leaf``, its group's ``subroot``, the ``root`` of all and the proof ``steps``, with the columns ``keep``.

    A partition of the tree has ``fanout ** levels`` rows; what a task holds of a row is its digests and ``keep``.
    """
    # a group's key in the order of the groups: null first, then by bytes
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`")), F.lit(""))
    nodes = docs.select(
        name.alias("_group"), F.col(f"`{key}`").alias("_key"), leaf_of(*[F.col(f"`{c}`") for c in fields]).alias("node"), F.struct(*(keep or (F.col(f"`{key}`"),))).alias("_row")
    )
    return climb(nodes, fanout, levels, grouped=True).select("_row.*", F.col("node").alias("leaf"), "subroot", "root", "steps")
