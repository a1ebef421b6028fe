"""Keyed state in streams: units that go stale by a timer, and observations that repeat within a delay.

Both need event time: a watermark trails the latest time seen by ``delay``, and what is
older than it is late and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stallwise.operators.store import KEY

UNIT = ["platform_code", "category_code"]
CHANGE = "platform_code string, category_code string, last_fetch timestamp, fresh boolean"


class Freshness(StatefulProcessor):
    """Of each unit the last fetch, and a timer at which it goes stale.

    Emits a row when a unit becomes fresh or is fetched anew, and one when its timer fires;
    the state of a stale unit is dropped.
    """

    def __init__(self, seconds: int) -> None:
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def change(self, key: tuple, at: pd.Timestamp, fresh: bool) -> pd.DataFrame:
        return pd.DataFrame({"platform_code": [key[0]], "category_code": [key[1]], "last_fetch": [at], "fresh": [fresh]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = max(batch["fetched_at"].max() for batch in rows)
        known = self.last.get()[0] if self.last.exists() else None
        if known is not None and pd.Timestamp(known) >= latest:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((latest.to_pydatetime(),))
        self.handle.registerTimer(int(latest.value // 1_000_000) + self.millis)
        yield self.change(key, latest, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = pd.Timestamp(self.last.get()[0])
        self.last.clear()
        yield self.change(key, at, False)

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Timers need the state store on disk, which also holds more keys than memory does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def freshness_changes(fetch_log: DataFrame, seconds: int = 900, delay: str = "10 minutes") -> DataFrame:
    """The stream of ``CHANGE``: when each (platform, category) is fetched, and when ``seconds`` have passed without a fetch."""
    with_state_store(fetch_log.sparkSession)
    rows = fetch_log.select(*[F.col(c).cast("string").alias(c) for c in UNIT], F.col("fetched_at").cast("timestamp").alias("fetched_at")).filter("fetched_at IS NOT NULL")
    return rows.withWatermark("fetched_at", delay).groupBy(*UNIT).transformWithStateInPandas(Freshness(seconds), outputStructType=CHANGE, outputMode="append", timeMode="EventTime")


def unit_states(changes: DataFrame) -> DataFrame:
    """The state of each unit after all its changes: a later fetch wins, and going stale comes after the fetch itself."""
    newest = F.struct("last_fetch", ~F.col("fresh"))
    return changes.groupBy(*UNIT).agg(F.max("last_fetch").alias("last_fetch"), F.max_by("fresh", newest).alias("fresh"))


def dedupe_recent(listings: DataFrame, event_time: str = "collected_at", delay: str = "2 days", key: list[str] = KEY) -> DataFrame:
    """A stream without repeats of a key within the watermark's ``delay``: state is dropped with time, for replays that are never older.

    Rows older than the watermark are left out; for replays of any age there is ``ingest_exact``.
    """
    return listings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows to files once each, until its input ends."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
