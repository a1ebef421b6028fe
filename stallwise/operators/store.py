"""Scanning, appending and summarising the listing store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.session import path_exists

KEY = ["platform_code", "source_key", "observed_on"]
LISTING = (
    "platform_code STRING, source_key STRING, source_url STRING, title STRING, price_kes STRING, observed_on DATE, "
    "was_price_kes STRING, seller_name STRING, brand STRING, breadcrumb STRING, in_stock BOOLEAN, rating STRING, "
    "rating_count INT, raw STRING, _corrupt_record STRING"
)


def scan_listings(spark: SparkSession, path: str) -> DataFrame:
    """Stored observations; money is read as text and cast once, unreadable lines are kept in ``_corrupt_record``."""
    rows = spark.read.schema(LISTING).option("mode", "PERMISSIVE").json(path)
    return rows.withColumns(
        {
            "price_kes": F.col("price_kes").try_cast("decimal(12,2)"),
            "was_price_kes": F.col("was_price_kes").try_cast("decimal(12,2)"),
            "rating": F.col("rating").try_cast("decimal(3,2)"),
        }
    )


def first_of_key(batch: DataFrame, arrival: list[str], key: list[str] = KEY) -> DataFrame:
    """One row a key: the first to arrive."""
    order = Window.partitionBy(*key).orderBy(*arrival)
    return batch.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def new_rows(batch: DataFrame, stored: DataFrame, arrival: list[str], key: list[str] = KEY) -> DataFrame:
    """The rows of ``batch`` whose key is not stored yet, the first of each."""
    return first_of_key(batch.join(stored.select(*key), key, "left_anti"), arrival, key)


def of_days(stored: DataFrame, batch: DataFrame, day: str = "observed_on", most: int = 1000) -> DataFrame:
    """The stored rows of the batch's days, as a filter that prunes partitions while the query is planned.

    A batch of more than ``most`` days gets their span instead of their list.
    """
    days = [r[0] for r in batch.select(day).filter(F.col(day).isNotNull()).distinct().limit(most + 1).collect()]
    if len(days) > most:
        first, last = batch.agg(F.min(day), F.max(day)).first()
        return stored.filter(F.col(day).between(first, last))
    return stored.filter(F.col(day).isin(days) if days else F.lit(False))


def append_listings(batch: DataFrame, path: str, arrival: list[str]) -> int:
    """Append what is new to the store at ``path``; the number appended. Running it again appends nothing.

    Only the batch's days are read of the store.
    """
    spark = batch.sparkSession
    exists = path_exists(spark, path)
    fresh = new_rows(batch, of_days(spark.read.parquet(path), batch), arrival) if exists else first_of_key(batch, arrival)
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n or not exists:
            fresh.write.mode("append").partitionBy("observed_on").parquet(path)
        return n
    finally:
        fresh.unpersist()


class ListingTable:
    """A store as a catalogue table, by period (day, month or year) and within periods bucketed by the listings' key.

    The key is one column, ``unit``, so that the anti join of a batch meets the stored rows in
    their buckets: the batch is exchanged by key, the store is not, however large it is. Of the
    store, only the keys of the batch's periods are read. A period should hold a file's worth of
    rows a bucket: each append adds a file to each bucket of the periods it has rows of. A row that lacks a part of the key is never a repeat.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int, period: str = "day") -> None:
        self.spark, self.name, self.path, self.buckets, self.period = spark, name, path, buckets, period

    def unit(self) -> Column:
        """Different keys give different units."""
        platform = F.col("platform_code").cast("string")
        return F.concat(F.length(platform).cast("string"), F.lit(":"), platform, F.col("observed_on").cast("string"), F.lit(":"), F.col("source_key").cast("string"))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("unit", "period")

    def fresh(self, batch: DataFrame, arrival: list[str]) -> DataFrame:
        """The first row of each key of the batch that the table does not have; batch and table meet bucket by bucket."""
        marked = batch.withColumns({"unit": self.unit(), "period": F.trunc("observed_on", self.period) if self.period != "day" else F.col("observed_on").cast("date")})
        placed = marked.repartition(self.buckets, "unit")  # the batch's one exchange; a task stays a bucket
        if self.spark.catalog.tableExists(self.name):
            seen = of_days(self.spark.table(self.name), marked, "period").select("unit")
            placed = placed.join(seen, "unit", "left_anti")
        first = F.row_number().over(Window.partitionBy("unit").orderBy(*arrival)) == 1
        return placed.withColumn("_first", first | F.col("unit").isNull()).filter("_first").drop("_first")

    def append(self, batch: DataFrame, arrival: list[str]) -> int:
        """Append what is new; the number appended. Each bucket of a period gets one file an append.

        The rows are counted as they are written, so that none are kept beside the store. An append without
        a new row adds no file.
        """
        written = Observation()
        placed = self.fresh(batch, arrival).repartition(self.buckets, "unit").observe(written, F.count(F.lit(1)).alias("n"))
        placed.write.mode("append").format("parquet").partitionBy("period").bucketBy(self.buckets, "unit").option("path", self.path).saveAsTable(self.name)
        return written.get.get("n", 0)

    def forget(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def product_dim(listings: DataFrame, arrival: list[str]) -> DataFrame:
    """First and last day of each product, with its latest attributes."""
    latest = F.struct("observed_on", *arrival)
    return listings.groupBy("platform_code", "source_key").agg(
        F.min("observed_on").alias("first_seen"),
        F.max("observed_on").alias("last_seen"),
        F.max_by("title", latest).alias("title"),
        F.max_by("brand", latest).alias("brand"),
        F.max_by("seller_name", latest).alias("seller_name"),
    )


def valid_listings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with title, key and a positive price, and the rejected ones with a reason."""
    reason = (
        F.when(F.col("title").isNull() | (F.trim("title") == ""), "no title")
        .when(F.col("source_key").isNull(), "no key")
        .when(F.col("price_kes").isNull(), "no price")
        .when(F.col("price_kes") <= 0, "price not positive")
    )
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def in_currency(currency: Column) -> Column:
    """Whether an offer is in shillings; a missing currency counts as such."""
    return F.upper(F.coalesce(currency, F.lit("KES"))).isin("KES", "KSH")


def seller_of(offer_seller: Column, brand: Column, platform_brand: str | None = None) -> Column:
    """The offer's seller, else the brand; null where that is the platform's own name."""
    seller = F.coalesce(F.nullif(offer_seller, F.lit("")), F.nullif(brand, F.lit("")))
    return seller if platform_brand is None else F.when(F.lower(F.trim(seller)) != platform_brand.lower(), seller)


def run_summary(enriched: DataFrame) -> DataFrame:
    """One row for the run, one for each platform and one for each category, in one pass.

    ``scope`` tells which; ``classification_rate`` has three places and is 0 for an empty run.
    """
    grouped = enriched.groupingSets([[], ["platform_code"], ["category_code"]], "platform_code", "category_code").agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("total"),
        F.count("category_code").alias("classified"),
        F.count_if("aggregatable").alias("aggregatable"),
    )
    scope = F.when(F.col("_g") == 3, "run").when(F.col("_g") == 1, "platform").otherwise("category")
    rate = F.round(F.coalesce(F.try_divide(F.col("classified").cast("double"), F.col("total")), F.lit(0.0)), 3)
    return grouped.select(
        scope.alias("scope"),
        F.when(F.col("_g") == 1, F.col("platform_code")).when(F.col("_g") == 2, F.col("category_code")).alias("code"),
        "total", "classified", "aggregatable", rate.alias("classification_rate"),
    )


def crawl_stats(fetch_log: DataFrame) -> DataFrame:
    """Per platform: urls seen, fetched, failed and blocked, rows written, and seconds from first to last fetch."""
    at = F.col("fetched_at").cast("timestamp")
    return fetch_log.groupBy("platform_code").agg(
        F.count("*").alias("urls_seen"),
        F.count_if(F.col("status") == "ok").alias("urls_ok"),
        F.count_if(F.col("status") == "failed").alias("urls_failed"),
        F.count_if(F.col("status") == "blocked").alias("urls_blocked"),
        F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows_written"),
        (F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))).alias("elapsed_s"),
    )


def fresh_units(fetch_log: DataFrame, now: Column, seconds: int = 900) -> DataFrame:
    """Whether each (platform, category) was fetched within ``seconds`` before ``now``."""
    last = fetch_log.groupBy("platform_code", "category_code").agg(F.max("fetched_at").alias("last_fetch"))
    return last.withColumn("fresh", (F.unix_timestamp(now) - F.unix_timestamp(F.col("last_fetch").cast("timestamp"))) < seconds)


def guard_not_empty(rows: DataFrame, expected: DataFrame, minimum: int) -> DataFrame:
    """Each expected platform with its row count and whether it reached ``minimum``; a platform without rows counts 0."""
    counts = rows.groupBy("platform_code").agg(F.count("*").alias("n_rows"))
    joined = expected.join(counts, "platform_code", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return joined.withColumn("passed", F.col("n_rows") >= minimum)


def require_units(rows: DataFrame, expected: DataFrame, minimum: int) -> DataFrame:
    """``rows``, in a plan that fails when an expected platform has fewer than ``minimum`` of them.

    The check is a part of what is computed: it adds no row, and no projection, filter or
    empty input takes it away, so the job that writes or counts the rows is the one that fails.
    """
    short = guard_not_empty(rows, expected, minimum).filter(~F.col("passed"))
    message = F.concat(F.lit("too few rows of "), "platform_code", F.lit(": "), F.col("n_rows").cast("string"), F.lit(f", need {minimum}"))
    failed = lambda kind: F.raise_error(message).cast(kind)
    # also each column fails, so that a filter on one cannot be found empty beforehand
    none = short.filter(failed("boolean")).select(*[failed(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(none)


def with_payload(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with their raw JSON as a variant, which is stored parsed; text that is no JSON becomes null."""
    return rows.withColumn(raw, F.try_parse_json(raw))


def payload(path: str, kind: str, raw: str = "raw") -> Column:
    """A field of the payload by its path; null where it is missing or of another kind."""
    return F.try_variant_get(raw, path, kind)


def write_rollup(rollups: DataFrame, path: str) -> None:
    """Store rollups by day; writing a day again replaces that day and no other."""
    rollups.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("observed_on").parquet(path)


def append_question_log(answers: DataFrame, path: str) -> None:
    """Add answered questions to the log, by day; accounts appear under their pseudonym only."""
    columns = ["account_ref", "asked_at", "question", "intent", "answered", "text", "observation_ct"]
    answers.select(*columns, F.to_date("asked_at").alias("day")).write.mode("append").partitionBy("day").parquet(path)
