"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a target by its weight; a target stops at twice its source's
size and the excess goes to the others by weight. A source's target is cut into
equal-token blocks. Slot ``j`` of the schedule takes the golden-ratio point
``frac(j / phi)`` through the cumulative block shares to a source, and the slots
of a source are ranked: its slot of rank ``k`` takes its block ``k``. Blocks run
over the source's documents in shuffled (hash) order, and over them once more
where the target is above the source's size. So at any prefix of the schedule
all sources are at about the same part of their targets.

Null texts have size 0. Null sources are one source, sorted last. Documents of
size 0 are kept with ``taken`` 0. Repeated rows count one by one. With all sizes
0 all targets are 0. Columns called ``source_size``, ``target`` or ``taken`` are
replaced; others may have any name. An empty table gives an empty result. Texts are only
measured, whatever their length; documents of one hash are ordered by size and are otherwise alike. The table of sources (one row each, aggregated) is the only
thing sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Points per unit; GOLDEN / ONE is the golden ratio's inverse.
ONE = 1 << 31
GOLDEN = 1_327_217_885
#: Parts of the unit interval that slots and sources meet by.
PARTS_SHIFT = 19
#: Documents or slots that one running sum goes over, about.
CELL_ROWS = 512
#: More slots than blocks, since a source's share of the points varies by a few.
SPARE = 1.05


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``: its number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(docs: DataFrame, weights: list[int], share: float, block: int = 512, least_blocks: int = 256) -> DataFrame:
    """One row a source: its number, size, target and blocks."""
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = (
        sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_ratio", 2.0 * F.col("source_size") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_level", (F.lit(share) * F.col("_total") - F.coalesce(F.sum(2 * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "sid", "_level"))).over(everything)["_level"])
        .withColumn("target", F.least(2.0 * F.col("source_size"), F.col("_level") * F.col("weight")))
    )
    goal = F.floor("target").cast("long")
    n = F.least(F.greatest(F.lit(least_blocks), F.ceil(F.col("target") / block)), F.greatest(goal, F.lit(1)))
    in_order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("goal", goal)
        .withColumn("block", F.greatest(F.ceil(F.col("goal") / n), F.lit(1)).cast("long"))
        .withColumn("blocks", F.ceil(F.col("goal") / F.col("block")).cast("long"))
        .withColumn("_first", F.coalesce(F.sum("blocks").over(in_order), F.lit(0)))
        .withColumn("_all", F.sum("blocks").over(everything))
        .withColumn("lo", F.floor(F.col("_first") / F.greatest("_all", F.lit(1)) * ONE).cast("long"))
        .withColumn("hi", F.floor((F.col("_first") + F.col("blocks")) / F.greatest("_all", F.lit(1)) * ONE).cast("long"))
        .select("source", "sid", "source_size", "n_docs", "target", "goal", "block", "blocks", "lo", "hi", F.col("_all").alias("all_blocks"))
    )


def schedule(sources: DataFrame) -> DataFrame:
    """The slots: ``slot``, ``sid`` and ``rank``, which is the source's block that the slot takes.

    Each block of a source gets one: the few that the points leave without one, which only
    small sources have, come after all points, in order.
    """
    spark = sources.sparkSession
    n = sources.agg(F.max("all_blocks")).first()[0] or 0
    n_points = int(n * SPARE) + 64 if n else 0
    points = spark.range(n_points).select(
        F.col("id").alias("slot"), (F.col("id") % ONE * GOLDEN % ONE).alias("_u")
    )
    spans = sources.filter("hi > lo").select(
        "sid",
        "blocks",
        "lo",
        "hi",
        F.greatest(F.lit(1), F.floor(CELL_ROWS * F.col("all_blocks") / F.col("blocks"))).cast("long").alias("_width"),
        F.explode(F.sequence(F.shiftright("lo", PARTS_SHIFT), F.shiftright(F.col("hi") - 1, PARTS_SHIFT))).alias("_part"),
    )
    hit = (
        points.withColumn("_part", F.shiftright("_u", PARTS_SHIFT))
        .join(spans, "_part")
        .filter("_u >= lo AND _u < hi")
        .select("slot", "sid", "blocks", F.floor(F.col("slot") / F.col("_width")).alias("_cell"))
    )
    before = Window.partitionBy("sid").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = hit.groupBy("sid", "_cell").agg(F.count("*").alias("_n"))
    starts = starts.select("sid", "_cell", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    have = starts.groupBy("sid").agg((F.max_by(F.col("_start") + F.col("_n"), "_cell")).alias("_have"))
    short = sources.join(have, "sid", "left").select("sid", "blocks", F.coalesce("_have", F.lit(0)).alias("_have")).filter("_have < blocks")
    earlier = F.coalesce(F.sum(F.col("blocks") - F.col("_have")).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = short.withColumn("_slot", n_points + earlier - F.col("_have")).withColumn("rank", F.explode(F.sequence("_have", F.col("blocks") - 1)))
    late = late.select((F.col("_slot") + F.col("rank")).alias("slot"), "sid", "rank")
    inside = Window.partitionBy("sid", "_cell").orderBy("slot")
    ranked = (
        hit.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts.drop("_n"), ["sid", "_cell"])
        .withColumn("rank", F.col("_start") + F.col("_at"))
        .filter("rank < blocks")
        .select("slot", "sid", "rank")
    )
    return ranked.unionByName(late)


def shuffled(docs: DataFrame, sources: DataFrame, row_id: str = "doc_id", seed: str = "mix") -> DataFrame:
    """``docs`` joined to their sources, with ``_start``: the words before a document in its source's shuffled order."""
    by_hash = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))).cast("binary"))
    cells = F.floor(F.col("n_docs") / CELL_ROWS) + 1
    dealt = (
        docs.withColumn("_null", F.col("source").isNull())
        .withColumn("_source", F.coalesce("source", F.lit("")))
        .join(
            sources.select(
                F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"),
                "sid", "source_size", "n_docs", "target", "goal", "block",
            ),
            ["_null", "_source"],
        )
        .withColumn("_hash", by_hash)
        .withColumn("_cell", F.shiftright(F.conv(F.substring("_hash", 1, 7), 16, 10).cast("long") * cells, 28))
        .drop("_null", "_source")
    )
    before = Window.partitionBy("sid").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("sid", "_cell").agg(F.sum("size").alias("_n"))
    starts = starts.select("sid", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", "_cell").orderBy("_hash", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        dealt.withColumn("_running", running)
        .withColumn("_no", F.row_number().over(inside))
        .join(starts, ["sid", "_cell"])
        .withColumn("_start", F.col("_base") + F.col("_running") - F.col("size"))
        .drop("_base", "_running", "_hash")
    )


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    row_id: str = "doc_id",
    seed: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (needing ``source`` and ``size``) with ``source_size``, ``target`` and ``taken``.

    ``docs`` is read more than once, so give a cut or stored table.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("source_size", "target", "taken")]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), F.col(row_id).alias("_id"), "source", "size")
    sources = cut_lineage(targets(docs, weights, share))
    rows = shuffled(docs, sources, "_id", seed)

    def pieces(again: int):
        a = F.col("source_size") * again + F.col("_start")
        b = F.least(a + F.col("size"), F.col("goal"))
        spans = F.transform(
            F.sequence(F.floor(a / F.col("block")), F.floor((b - 1) / F.col("block"))),
            lambda k: F.struct(
                k.alias("rank"),
                (F.least(b, (k + 1) * F.col("block")) - F.greatest(a, k * F.col("block"))).alias("words"),
            ),
        )
        return F.when(a < b, spans).otherwise(F.array().cast("array<struct<rank:bigint,words:bigint>>"))

    cut = rows.withColumn("_piece", F.explode_outer(F.concat(pieces(0), pieces(1))))
    taken = cut.withColumns({"rank": F.col("_piece.rank"), "_words": F.col("_piece.words")}).drop("_piece")
    slots = schedule(sources).select("sid", "rank", F.lit(True).alias("_slot"))
    return (
        taken.join(slots, ["sid", "rank"], "left")
        .groupBy("sid", "_cell", "_no", "source_size", "target", "_kept")
        .agg(F.coalesce(F.sum(F.when(F.col("_slot"), F.col("_words"))), F.lit(0)).cast("long").alias("taken"))
        .select("_kept.*", "source_size", "target", "taken")
    )
