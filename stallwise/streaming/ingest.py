"""Exactly-once ingestion of listings as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwise.operators.store import append_listings


def ingest_exact(listings: DataFrame, store: str, checkpoint: str, arrival: list[str]) -> StreamingQuery:
    """Append each micro-batch's new observations to the store; replays of any age add nothing."""

    def append(batch: DataFrame, _: int) -> None:
        append_listings(batch, store, arrival)

    return listings.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawl_metrics() -> dict[str, Column]:
    """What a crawl's fetch log is counted by as it passes."""
    return {
        "urls_seen": F.count(F.lit(1)),
        "urls_ok": F.count_if(F.col("status") == "ok"),
        "urls_failed": F.count_if(F.col("status") == "failed"),
        "urls_blocked": F.count_if(F.col("status") == "blocked"),
        "first_fetch": F.min("fetched_at"),
        "last_fetch": F.max("fetched_at"),
    }


def ingest_observed(log: DataFrame, store: str, runs: str, checkpoint: str, arrival: list[str]) -> StreamingQuery:
    """As ``ingest_exact`` of the fetches that are ok, with a row of ``crawl_run`` for each micro-batch in ``runs``.

    The run is counted while its rows are appended, so the log is not read again for it. A
    micro-batch that is run again writes its row over the first; the rows appended are then those of the second time.
    """

    def append(batch: DataFrame, number: int) -> None:
        seen = Observation(f"crawl_run_{number}")
        measures = crawl_metrics()
        watched = batch.observe(seen, *[m.alias(n) for n, m in measures.items()]).persist()
        try:
            watched.count()
            written = append_listings(watched.filter("status = 'ok'"), store, arrival)
        finally:
            watched.unpersist()
        row = {"run": number, **seen.get, "rows_written": written}
        schema = "run long, urls_seen long, urls_ok long, urls_failed long, urls_blocked long, first_fetch timestamp, last_fetch timestamp, rows_written long"
        spark = batch.sparkSession
        spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema).coalesce(1).write.mode("overwrite").parquet(f"{runs}/batch={number}")

    return log.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
