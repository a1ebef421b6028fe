"""A join with facts about keys of which one may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with a share of ``1 / HOT_KEYS`` of the rows is hot, so at most so many are.
HOT_KEYS = 1024


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, spread: list[str]) -> DataFrame:
    """``rows`` with the columns of ``facts``, null where it lacks their key.

    ``facts`` has one row a key and how many ``_rows`` of the ``total`` have it. The facts of
    hot keys, ``HOT_KEYS`` at most, are broadcast. The rows that they settle, and those with a null in their key, match
    nothing in the exchange for the others, where the columns ``spread`` and the part they come from deal them over all tasks.
    """
    own = [c for c in facts.columns if c not in (*keys, "_rows")]
    is_hot = F.col("_rows") * HOT_KEYS >= total
    hot = facts.filter(is_hot).select(*keys, F.struct(*own).alias("_hot"))
    others = facts.filter(~is_hot).select(*keys, F.xxhash64(*keys).alias("_salt"), F.struct(*own).alias("_other"))
    settled = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.col("_hot").isNotNull())
    out = rows.join(F.broadcast(hot), keys, "left")
    out = out.withColumn("_salt", F.when(settled, F.xxhash64(*spread, F.spark_partition_id())).otherwise(F.xxhash64(*keys)))
    out = out.join(others, [*keys, "_salt"], "left").withColumn("_facts", F.coalesce("_hot", "_other"))
    return out.select(*rows.columns, *[F.col("_facts")[c].alias(c) for c in own])
