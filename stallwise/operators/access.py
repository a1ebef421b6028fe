"""Row filters by account tier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seen(rows: DataFrame, tiers: DataFrame, today: Column) -> DataFrame:
    """The rows that each tier may see, once a tier."""
    rights = tiers.select("tier", F.explode("platforms").alias("platform_code"), "history_days")
    seen = rows.join(rights, "platform_code").filter(
        F.col("history_days").isNull() | (F.col("observed_on") >= F.date_sub(today, F.coalesce("history_days", F.lit(0))))
    )
    return seen.drop("history_days")


def _holders(accounts: DataFrame) -> DataFrame:
    return accounts.filter("active").select("account_ref", "tier")


def entitled_rows(rows: DataFrame, accounts: DataFrame, tiers: DataFrame, today: Column) -> DataFrame:
    """For every active account the rows of the platforms and days its tier may see.

    ``tiers`` has ``tier``, ``platforms`` and ``history_days`` (null: all). The rows meet the
    tiers first, so they are filtered by day once a tier; accounts come last.
    """
    return _seen(rows, tiers, today).join(_holders(accounts), "tier").drop("tier")


def entitled_totals(rows: DataFrame, accounts: DataFrame, tiers: DataFrame, today: Column, measures: dict[str, Callable[[str], Column]]) -> DataFrame:
    """For every active account and platform it may see the ``measures`` of its ``entitled_rows``.

    ``measures`` are columns with an aggregate that merges its own results, as sums and extremes
    do. What a tier sees is aggregated once and then meets the tier's accounts, so the rows made
    are accounts times platforms, however many rows an account may see.
    """
    merged = lambda: [f(name).alias(name) for name, f in measures.items()]
    totals = _seen(rows, tiers, today).groupBy("tier", "platform_code").agg(*merged())
    return totals.join(_holders(accounts), "tier").groupBy("account_ref", "platform_code").agg(*merged())
