"""Stores by day that a stream keeps current: a micro-batch rewrites the days it touches and no other.

A store has one merged set of rows a day, so it grows with the days and their distinct
rows and not with the number of micro-batches. Each day notes the last micro-batch merged
into it (``through``): one that is run again after a failure finds the days it has already
reached and leaves them alone, whether the failure came before, between or after the days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwise.operators.rollup import LEAST_ROWS, rollup
from stallwise.operators.store import write_rollup
from stallwise.session import path_exists

HISTOGRAM = ["category_code", "platform_code", "observed_on", "price_kes", "seller_name"]
SERIES = ("category_code", "platform_code", "observed_on")
#: Base-2 logarithm of a sketch's registers: a standard error of 0.65 % (a day's first few thousand sellers are counted almost exactly).
SKETCH_SIZE = 14


def merge_days(increments: DataFrame, path: str, number: int, keys: list[str], sums: list[Column], day: str = "observed_on") -> None:
    """Merge a micro-batch's rows by ``keys`` into the store; ``sums`` merge rows of the same keys.

    Only the touched days of the store are read. Rows without a day have no place and are left out.
    """
    spark = increments.sparkSession
    fresh = increments.filter(F.col(day).isNotNull())
    if path_exists(spark, path):
        touched = fresh.select(day).distinct()
        stored = spark.read.parquet(path).join(touched, day, "left_semi")
        reached = stored.filter(F.col("through") >= number).select(day).distinct()
        fresh = fresh.join(reached, day, "left_anti").unionByName(stored.filter(F.col("through") < number).drop("through"))
    merged = fresh.groupBy(*keys).agg(*sums).withColumn("through", F.lit(number).cast("long"))
    # rebalanced: a day's rows meet in few files, a day with very many is split
    merged.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def run_to_end(rows: DataFrame, checkpoint: str, each) -> StreamingQuery:
    """Start ``each(batch, number)`` for the micro-batches that are there."""
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_histogram(listings: DataFrame, store: str, checkpoint: str, rollups: str | None = None, minimum: int = LEAST_ROWS) -> StreamingQuery:
    """Keep counts of (category, platform, day, price, seller) as listings arrive.

    The counts add up, so the exact figures of any day come from the histogram, without
    the listings. With ``rollups`` the daily rollup of (category, platform) is kept current
    there: figures, evidence and refusals of the touched days are written anew.
    """

    def each(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(*HISTOGRAM).agg(F.count("*").alias("n")).persist()
        try:
            merge_days(counts, store, number, HISTOGRAM, [F.sum("n").alias("n")])
            if rollups is not None:
                days = counts.select("observed_on").distinct()
                write_rollup(figures(batch.sparkSession.read.parquet(store).join(days, "observed_on", "left_semi"), minimum), rollups)
        finally:
            counts.unpersist()

    return run_to_end(listings, checkpoint, each)


def figures(histogram: DataFrame, minimum: int = LEAST_ROWS) -> DataFrame:
    """The daily rollup from the stored histogram alone."""
    return rollup(histogram, SERIES, minimum, weight="n")


def activity_counts(events: DataFrame, store: str, checkpoint: str, event_time: str = "ts") -> StreamingQuery:
    """Keep counts of (day, category, seller) as events arrive: exact, one row a seller and day; no row is too late."""
    keys = ["day", "category_code", "seller_name"]
    rows = events.select(F.to_date(event_time).alias("day"), *keys[1:])

    def each(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(*keys).agg(F.count("*").alias("n")).persist()
        try:
            merge_days(counts, store, number, keys, [F.sum("n").alias("n")], day="day")
        finally:
            counts.unpersist()

    return run_to_end(rows, checkpoint, each)


def activity_rows(counts: DataFrame) -> DataFrame:
    """The listings and distinct sellers of each category and day, exact."""
    return counts.groupBy("day", "category_code").agg(F.sum("n").alias("listings"), F.count("seller_name").alias("sellers"))


def activity_sketches(events: DataFrame, store: str, checkpoint: str, event_time: str = "ts") -> StreamingQuery:
    """Keep the listings of each (day, category) and a sketch of its sellers as events arrive; one row a day and category.

    Sketches merge, so no row is too late, a seller seen in several micro-batches counts once,
    and sketches of days give the sellers of a month.
    """
    rows = events.select(F.to_date(event_time).alias("day"), "category_code", F.col("seller_name").cast("string").alias("seller_name"))
    keys = ["day", "category_code"]

    def each(batch: DataFrame, number: int) -> None:
        seen = batch.groupBy(*keys).agg(F.count("*").alias("listings"), F.hll_sketch_agg("seller_name", SKETCH_SIZE).alias("sketch")).persist()
        try:
            merge_days(seen, store, number, keys, [F.sum("listings").alias("listings"), F.hll_union_agg("sketch").alias("sketch")], day="day")
        finally:
            seen.unpersist()

    return run_to_end(rows, checkpoint, each)


def activity_bitmaps(events: DataFrame, store: str, checkpoint: str, event_time: str = "ts") -> StreamingQuery:
    """As ``activity_sketches``, exact: the sellers are whole numbers and each (day, category) keeps a bit for every one seen.

    A row holds the bits of 32,768 neighbouring numbers (4 KB, few bytes when stored if few are
    set), so rows and memory are in proportion to the ranges of numbers that occur. Bits merge as
    sketches do.
    """
    seller = F.col("seller_name").cast("long")
    rows = events.select(F.to_date(event_time).alias("day"), "category_code", F.bitmap_bucket_number(seller).alias("bucket"), F.bitmap_bit_position(seller).alias("_bit"))
    keys = ["day", "category_code", "bucket"]

    def each(batch: DataFrame, number: int) -> None:
        seen = batch.groupBy(*keys).agg(F.count("*").alias("listings"), F.bitmap_construct_agg("_bit").alias("sellers")).persist()
        try:
            merge_days(seen, store, number, keys, [F.sum("listings").alias("listings"), F.bitmap_or_agg("sellers").alias("sellers")], day="day")
        finally:
            seen.unpersist()

    return run_to_end(rows, checkpoint, each)


def exact_activity(bitmaps: DataFrame, keys: tuple[str, ...] = ("day", "category_code")) -> DataFrame:
    """Listings and distinct sellers, both exact, by ``keys``, which may leave out day or category."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.sum("listings").alias("listings"), F.bitmap_count(F.bitmap_or_agg("sellers")).alias("sellers"))
    return merged.groupBy(*keys).agg(F.sum("listings").alias("listings"), F.sum("sellers").alias("sellers"))


def activity(sketches: DataFrame, keys: tuple[str, ...] = ("day", "category_code")) -> DataFrame:
    """Listings and distinct sellers (estimated, with the error of ``SKETCH_SIZE``) by ``keys``, which may leave out day or category."""
    merged = sketches.groupBy(*keys).agg(F.sum("listings").alias("listings"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, "listings", F.hll_sketch_estimate("sketch").alias("sellers"))
