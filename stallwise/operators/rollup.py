"""Exact price figures per group, with evidence; a group with too few rows is a refusal row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows below which no figure is stated, sellers below which no index is, and the index's bands.
LEAST_ROWS = 30
LEAST_SELLERS = 3
CROWDED, COMPETITIVE = 6.0, 3.0


def quantiles(rows: DataFrame, keys: list[str], value: str = "price_kes", weight: str | None = None) -> DataFrame:
    """Per group the exact 25 %, 50 % and 75 % quantiles of a decimal column, interpolated and rounded half up to 0.01.

    Rows are first counted by distinct value, so what is exchanged and sorted is
    the values of a group and not its rows. With ``weight`` a row stands for so many.
    """
    by_value = Window.partitionBy(*keys).orderBy(value)
    cum = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
        .withColumn("_to", F.sum("_n").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    figures = []
    for k in (1, 2, 3):
        at = k * (F.col("_all") - 1)
        low = F.floor(at / 4)
        high = F.least(low + 1, F.col("_all") - 1)
        figures += [
            F.min(F.when(F.col("_to") > low, F.col(value))).alias(f"_lo{k}"),
            F.min(F.when(F.col("_to") > high, F.col(value))).alias(f"_hi{k}"),
            F.max(at % 4).alias(f"_part{k}"),
        ]
    grouped = cum.groupBy(*keys).agg(*figures)

    def between(k: int) -> Column:
        quarter = (F.col(f"_part{k}").cast("decimal(2,0)") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(4,2)")
        return F.round(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * quarter, 2).cast("decimal(12,2)")

    return grouped.select(*keys, between(1).alias("p25"), between(2).alias("median"), between(3).alias("p75"))


def saturation_index(listings: Column, sellers: Column, spread: Column, median: Column) -> Column:
    """Listings a seller, weighted up to twofold as prices converge; null below the seller floor."""
    relative = F.least(spread.cast("double") / F.nullif(median.cast("double"), F.lit(0.0)), F.lit(1.0))
    index = listings / F.nullif(sellers, F.lit(0)) * (1.0 + F.greatest(F.lit(0.0), 1.0 - relative))
    return F.when((sellers >= LEAST_SELLERS) & (listings > 0) & (median > 0), F.round(index, 3))


def saturation_label(index: Column) -> Column:
    return F.when(index.isNull(), "unknown").when(index >= CROWDED, "crowded").when(index >= COMPETITIVE, "competitive").otherwise("room")


def rollup(enriched: DataFrame, keys: tuple[str, ...] = ("category_code", "platform_code"), minimum: int = LEAST_ROWS, platforms: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """One row a group of aggregatable rows: figures, saturation and evidence, or why not.

    Add ``observed_on`` to the keys for the daily series. ``platforms``
    (``platform_code``, ``caveat``) adds the platform's caveat. With ``weight`` a row
    stands for so many observations.
    """
    keys = list(keys)
    rows = enriched.filter("aggregatable") if "aggregatable" in enriched.columns else enriched
    seller = F.nullif(F.col("seller_name"), F.lit(""))
    evidence = rows.filter("price_kes IS NOT NULL").groupBy(*keys).agg(
        (F.count("*") if weight is None else F.sum(weight)).alias("observation_count"),
        F.count_distinct(seller).alias("seller_count"),
        F.min("price_kes").alias("_min"),
        F.max("price_kes").alias("_max"),
        F.max("observed_on").alias("collected_on") if "observed_on" not in keys else F.lit(None).cast("date").alias("_"),
    )
    out = evidence.join(quantiles(rows, keys, weight=weight), keys)
    enough = F.col("observation_count") >= minimum
    out = out.withColumn("available", enough)
    for name, source in (("median", "median"), ("p25", "p25"), ("p75", "p75"), ("min", "_min"), ("max", "_max")):
        out = out.withColumn(name, F.when(enough, F.col(source)))
    out = (
        out.withColumn("spread", (F.col("p75") - F.col("p25")).cast("decimal(12,2)"))
        .withColumn("saturation_index", saturation_index(F.col("observation_count"), F.col("seller_count"), F.col("spread"), F.col("median")))
        .withColumn("saturation_label", F.when(enough, saturation_label(F.col("saturation_index"))))
        .withColumn("needed", F.when(~enough, minimum))
        .withColumn("reason", F.when(~enough, F.concat(F.col("observation_count").cast("string"), F.lit(f" observations, need at least {minimum}"))))
        .drop("_min", "_max", "_")
    )
    if platforms is not None:
        caveats = platforms.select("platform_code", F.array_compact(F.array("caveat")).alias("caveats"), F.lit(True).alias("_known"))
        out = known_platforms(out.join(caveats, "platform_code", "left")).drop("_known")
    return out


def known_platforms(rows: DataFrame, known: str = "_known") -> DataFrame:
    """``rows``, in a plan that fails on a platform whose ``known`` is null; as a filter it is not pruned."""
    unknown = F.raise_error(F.concat(F.lit("unknown platform "), F.coalesce("platform_code", F.lit("(none)"))))
    return rows.filter(F.when(F.col(known).isNull(), unknown.cast("boolean")).otherwise(True))


def with_evidence(enriched: DataFrame, platforms: DataFrame, keys: tuple[str, ...] = ("category_code",), minimum: int = LEAST_ROWS) -> DataFrame:
    """The rollup by ``keys`` with ``evidence``: rows, sellers, the platforms that they come from, the last day and those platforms' caveats.

    Keys without the platform pool all platforms. Platforms and caveats are in the platforms'
    order; a platform that ``platforms`` (``platform_code``, ``caveat``) does not have fails the job.
    """
    rows = enriched.filter("aggregatable") if "aggregatable" in enriched.columns else enriched
    pairs = rows.filter("price_kes IS NOT NULL").groupBy(*keys, *[c for c in ["platform_code"] if c not in keys]).agg(F.count("*").alias("_n"))
    pairs = known_platforms(pairs.join(platforms.select("platform_code", "caveat", F.lit(True).alias("_known")), "platform_code", "left"))
    ordered = F.array_sort(F.collect_list(F.struct("platform_code", "caveat")))
    seen = pairs.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(ordered.alias("_seen"))
    out = rollup(enriched, keys, minimum)
    out = out.join(seen, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    evidence = F.struct("observation_count", "seller_count", F.col("_seen.platform_code").alias("platforms"), "collected_on", F.array_compact("_seen.caveat").alias("caveats"))
    return out.withColumn("evidence", evidence).drop("_seen", *[f"_{k}" for k in keys])


def run_counts(rollups: DataFrame) -> DataFrame:
    """One row a run: groups with figures, groups too thin for any, and the rows behind each."""
    ok, n = F.col("available"), F.col("observation_count")
    return rollups.agg(
        F.count_if(ok).alias("with_figures"), F.count_if(~ok).alias("too_thin"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("rows_with_figures"), F.coalesce(F.sum(F.when(~ok, n)), F.lit(0)).alias("rows_too_thin"),
    )


def tenths(value: Column) -> Column:
    """A double to one decimal, in doubles: halves of the tenfold value go away from zero, and what is just below zero is -0.0."""
    return F.signum(value) * F.round(F.abs(value) * 10, 0) / 10


def price_trend(daily: DataFrame, keys: tuple[str, ...] = ("category_code", "platform_code"), minimum_points: int = 3) -> DataFrame:
    """Direction of a series of daily medians, by its first and last day; a short series is a refusal row."""
    at = [F.min_by("median", "observed_on"), F.max_by("median", "observed_on")]
    out = daily.filter("median IS NOT NULL AND observation_count >= 1").groupBy(*keys).agg(
        F.count("*").alias("points"), F.min("observed_on").alias("from_date"), F.max("observed_on").alias("to_date"), at[0].alias("_first"), at[1].alias("_last")
    )
    change = F.col("_last") - F.col("_first")
    percent = F.coalesce(F.try_divide(change.cast("double"), F.col("_first").cast("double")) * 100, F.lit(0.0))
    enough = F.col("points") >= minimum_points
    direction = F.when(F.abs(percent) < 3.0, "flat").when(change > 0, "rising").otherwise("falling")
    return out.select(
        *keys, "points", enough.alias("available"),
        F.when(enough, direction).alias("direction"),
        F.when(enough, change.cast("decimal(12,2)")).alias("change_kes"),
        F.when(enough, tenths(percent)).alias("change_percent"),
        F.when(enough, F.col("from_date")).alias("from_date"),
        F.when(enough, F.col("to_date")).alias("to_date"),
        F.when(~enough, F.concat(F.col("points").cast("string"), F.lit(f" days of history, need at least {minimum_points}"))).alias("reason"),
    )


def example_listings(enriched: DataFrame, order: list[str], limit: int = 3) -> DataFrame:
    """Up to ``limit`` listings of each group priced nearest its upper middle price; ``order`` breaks ties.

    Rows are counted by price, and these counts by cells of about 0.1 % of a price. Only the prices in
    the cells around the middle are sorted, and only rows at the prices within the distance that holds
    ``limit`` rows are gathered by group. These cells and prices, a few a group, are broadcast, since a
    join by shuffle would give a task all rows of a group.
    """
    keys = ["category_code", "platform_code"]
    # null keys, which the joins leave out, are left out before, so that Spark makes the counts once for both their uses
    priced = enriched.filter("price_kes IS NOT NULL AND price_kes > 0 AND source_url IS NOT NULL AND category_code IS NOT NULL AND platform_code IS NOT NULL")
    group = Window.partitionBy(*keys)
    upward = lambda column: group.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = F.coalesce(F.rint(F.log10("price_kes") * 2000), F.lit(0.0))  # never null, or the join below would filter one use
    counts = priced.groupBy(*keys, "price_kes").agg(F.count("*").alias("_n")).withColumn("_cell", cell)
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_prices")).select(
        *keys, "_cell", "_rows", "_prices",
        F.sum("_rows").over(upward("_cell")).alias("_to"),
        F.sum("_prices").over(upward("_cell")).alias("_last"),
        F.floor(F.sum("_rows").over(group) / 2).alias("_half"),
    )
    before, first = F.col("_to") - F.col("_rows"), F.col("_last") - F.col("_prices")
    in_middle = (F.col("_to") > F.col("_half")) & (before <= F.col("_half"))
    # prices are numbered upward: the middle one's cell, and those that hold `limit` prices on each side of it
    around = (
        cells.withColumns({"_from": F.max(F.when(in_middle, first)).over(group), "_till": F.max(F.when(in_middle, F.col("_last"))).over(group)})
        .filter((F.col("_last") > F.col("_from") - limit) & (first < F.col("_till") + limit))
        .select(*keys, "_cell", before.alias("_before"), "_half")
    )
    within = group.orderBy("_away")  # rows as far away as this one included
    near = (
        counts.join(F.broadcast(around), [*keys, "_cell"])
        .withColumn("_to", F.min("_before").over(group) + F.sum("_n").over(upward("price_kes")))
        .withColumn("_middle", F.min(F.when(F.col("_to") > F.col("_half"), F.col("price_kes"))).over(group))
        .withColumn("_away", F.abs(F.col("price_kes") - F.col("_middle")))
        .withColumn("_near", F.sum("_n").over(within))
        .withColumn("_reach", F.min(F.when(F.col("_near") >= limit, F.col("_away"))).over(group))  # null: the group has fewer rows
        .filter("_reach IS NULL OR _away <= _reach")
        .select(*keys, "price_kes", "_away")
    )
    return (
        priced.join(F.broadcast(near), [*keys, "price_kes"])
        .withColumn("rank", F.row_number().over(group.orderBy("_away", *order)))
        .filter(F.col("rank") <= limit)
        .select(*keys, "rank", F.left("title", F.lit(90)).alias("title"), "price_kes", F.col("seller_name").alias("seller"), F.col("source_url").alias("url"))
    )


def short_of_evidence(rows: DataFrame, wanted: DataFrame, minimum: int = LEAST_ROWS) -> DataFrame:
    """The wanted (category, platform) pairs with fewer aggregatable rows than needed; none counts 0."""
    counts = rows.filter("aggregatable").groupBy("category_code", "platform_code").agg(F.count("*").alias("observation_count"))
    joined = wanted.join(counts, ["category_code", "platform_code"], "left").withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    return joined.filter(F.col("observation_count") < minimum)


def with_activity(rollups: DataFrame) -> DataFrame:
    """``rollups`` with ``activity_score`` and ``listings_per_seller``."""
    n, sellers = F.col("observation_count"), F.col("seller_count")
    return rollups.withColumns(
        {
            "activity_score": F.round(sellers + F.log10(F.greatest(n, F.lit(1)).cast("double")), 2),
            "listings_per_seller": F.coalesce(F.round(F.try_divide(n.cast("double"), sellers), 2), F.lit(0.0)),
        }
    )


def of_choice(rollups: DataFrame, platforms: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """The groups of the chosen platforms and categories; none chosen: all."""
    for column, chosen in (("platform_code", platforms), ("category_code", categories)):
        if chosen is not None:
            rollups = rollups.filter(F.col(column).isin(chosen) if chosen else F.lit(False))
    return rollups


def rank_activity(rollups: DataFrame, limit: int = 10, platforms: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """The busiest available groups of the chosen platforms and categories."""
    busy = with_activity(of_choice(rollups, platforms, categories).filter("available"))
    return busy.orderBy(F.desc("activity_score"), "category_code", "platform_code").limit(limit)


def rank_opportunity(rollups: DataFrame, limit: int = 5, pool: int = 100, platforms: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Of the busiest ``pool`` groups with enough sellers, those with the fewest listings a seller."""
    pooled = rank_activity(rollups, pool, platforms, categories).filter(F.col("seller_count") >= LEAST_SELLERS)
    return pooled.orderBy("listings_per_seller", F.desc("activity_score"), "category_code", "platform_code").limit(limit)
