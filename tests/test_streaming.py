"""Streams in several micro-batches: touched days, replays, late rows, timers and sketches."""

import os
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallwise.operators.rollup import rollup
from stallwise.streaming import daily, ingest, state

LISTING = "category_code string, platform_code string, observed_on date, price_kes decimal(12,2), seller_name string"


def arrive(spark, folder, batches, schema):
    """Files in order, each a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")


def end(query):
    query.awaitTermination()
    assert query.exception() is None


def listings(day, n, seed=0):
    return [("phones", "pm"[i % 2], date(2024, 1, day), Decimal((i * 37 + seed) % 900 + 10), None if i % 11 == 0 else f"s{i % 7}") for i in range(n)]


def files_of(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("observed_on=")}


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_rollup_kept_current(spark, tmp_path):
    first, second = [listings(1, 80), listings(2, 50)], [listings(2, 40, 5) + listings(3, 70), [("phones", "p", None, Decimal(5), "s1")]]
    stream = arrive(spark, tmp_path, first, LISTING)
    run = lambda: end(daily.price_histogram(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", f"{tmp_path}/rollups"))
    run()
    before = files_of(f"{tmp_path}/store"), files_of(f"{tmp_path}/rollups")
    assert set(before[0]) == set(before[1]) == {"observed_on=2024-01-01", "observed_on=2024-01-02"}
    stream = arrive(spark, tmp_path, second, LISTING)
    run()
    after = files_of(f"{tmp_path}/store"), files_of(f"{tmp_path}/rollups")
    for old, new in zip(before, after, strict=True):
        assert new["observed_on=2024-01-01"] == old["observed_on=2024-01-01"]
        assert new["observed_on=2024-01-02"] != old["observed_on=2024-01-02"] and "observed_on=2024-01-03" in new
    rows = spark.createDataFrame([r for batch in first + second for r in batch if r[2]], LISTING)
    want = rollup(rows, daily.SERIES)
    same(spark.read.parquet(f"{tmp_path}/rollups"), want)
    same(daily.figures(spark.read.parquet(f"{tmp_path}/store")), want)
    kept = spark.read.parquet(f"{tmp_path}/store")
    assert kept.groupBy("observed_on").agg(F.count_distinct("through")).agg(F.max("count(DISTINCT through)")).first()[0] == 1
    assert [r[0] for r in kept.select("through").distinct().orderBy("through").collect()] == [0, 2]


def test_micro_batch_run_again_changes_nothing(spark, tmp_path):
    """As after a failure that came when only some of the days were written."""
    count = lambda rows: spark.createDataFrame(rows, LISTING).groupBy(*daily.HISTOGRAM).agg(F.count("*").alias("n"))
    merge = lambda rows, number: daily.merge_days(count(rows), f"{tmp_path}/store", number, daily.HISTOGRAM, [F.sum("n").alias("n")])
    one, two = listings(1, 30) + listings(2, 30), listings(2, 30) + listings(3, 20)
    merge(one, 0)
    merge([r for r in two if r[2].day == 3], 1)
    merge(two, 1)
    merge(two, 1)
    merge(one, 0)
    same(spark.read.parquet(f"{tmp_path}/store").drop("through"), count(one + two))


def test_sketches_over_micro_batches(spark, tmp_path):
    rows = lambda k: spark.range(40_000).select(F.lit(datetime(2024, 1, 1, k)).alias("ts"), F.lit("c").alias("category_code"), (F.col("id") + k * 10_000).alias("seller_name"))
    for k in (2, 0, 1):
        rows(k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows(0).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    end(daily.activity_sketches(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint"))
    kept = spark.read.parquet(f"{tmp_path}/store")
    assert kept.count() == 1
    got = daily.activity(kept).first()
    assert got["listings"] == 120_000 and abs(got["sellers"] / 60_000 - 1) < 0.02
    assert daily.activity(kept, ("category_code",)).first()["sellers"] == got["sellers"]


def test_activity_has_every_day(spark, tmp_path):
    """In files whose days go backwards."""
    schema = "ts timestamp, category_code string, seller_name string"
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i * 5), "ab"[i % 2], None if i % 9 == 0 else f"s{i % 4}") for i in range(60)]
    stream = arrive(spark, tmp_path, [rows[30:], rows[:40]], schema)
    end(daily.activity_counts(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint"))
    all_rows = spark.createDataFrame(rows[30:] + rows[:40], schema)
    want = all_rows.groupBy(F.to_date("ts").alias("day"), "category_code").agg(F.count("*").alias("listings"), F.count_distinct("seller_name").alias("sellers"))
    same(daily.activity_rows(spark.read.parquet(f"{tmp_path}/store")), want)


def at(minute):
    return datetime(2024, 1, 1, 12) + timedelta(minutes=minute)


def test_units_go_stale_by_a_timer(spark, tmp_path):
    """Unit a is fetched again in time, b is not and comes back later, c only comes too late; a replay changes nothing."""
    schema = "platform_code string, category_code string, fetched_at timestamp"
    a, b, c, clock = ("p", "a"), ("p", "b"), ("p", "c"), ("p", "clock")
    batches = [[(*a, at(0)), (*b, at(1)), (*b, at(0))], [(*a, at(10)), (*clock, at(12))], [(*clock, at(18))], [(*a, at(10)), (*c, at(2)), (*clock, at(19))], [(*b, at(30)), (*clock, at(31))], [(*clock, at(31))]]
    stream = arrive(spark, tmp_path, batches, schema)
    end(state.append_stream(state.freshness_changes(stream, 900, "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    changes = spark.read.parquet(f"{tmp_path}/out")
    got = {k: sorted((r["last_fetch"], not r["fresh"]) for r in changes.collect() if r["category_code"] == k) for k in "abc"}
    assert got["a"] == [(at(0), False), (at(10), False), (at(10), True)]
    assert got["b"] == [(at(1), False), (at(1), True), (at(30), False)]
    assert got["c"] == []
    now = {r["category_code"]: (r["last_fetch"], r["fresh"]) for r in state.unit_states(changes).collect()}
    assert now == {"a": (at(10), False), "b": (at(30), True), "clock": (at(31), True)}


@pytest.mark.parametrize("exact", [False, True])
def test_replays_and_late_rows(spark, tmp_path, exact):
    """A repeat within the delay is dropped by both forms; a row older than the watermark only by the one with bounded state."""
    schema = "platform_code string, source_key string, observed_on date, collected_at timestamp"
    row = lambda key, hour: ("p", key, date(2024, 1, 1), datetime(2024, 1, 1) + timedelta(hours=hour))
    batches = [[row("x", 1), row("y", 2)], [row("x", 1), row("z", 30)], [row("z", 30), row("clock", 80)], [row("clock", 81)], [row("late", 3), row("x", 1), row("new", 79)]]
    stream = arrive(spark, tmp_path, batches, schema)
    if exact:
        end(ingest.ingest_exact(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", ["collected_at"]))
    else:
        end(state.append_stream(state.dedupe_recent(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    keys = sorted(r["source_key"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert keys == sorted(["x", "y", "z", "clock", "new"] + ["late"] * exact)
