"""Sharding by a histogram sort on exact bytes.

Rows are ordered by a key: 16 hex digits of their text's hash, then 16 of their
id's. Splitters are searched by counting the exact bytes below candidate
boundaries: each round splits the open ranges at 4,096 probes (three more hex
digits), sums the bytes between probes in every partition and refines the range
that a splitter's target falls in, until the nearest boundary is within
``tolerance`` of a shard's share. A boundary in the first 16 digits keeps equal
texts together; only a group of copies too large for the tolerance is cut, along
the ids. Rows are then exchanged once, by shard and key cell.

Null texts count no bytes and hash as the empty text. Repeated rows are kept, each
with a slot of its own. An empty table gives an empty result. Columns of the input
called ``shard`` or ``slot`` are replaced. With fewer rows than shards, or a row
larger than a shard's share, some shards stay empty.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEXT_DIGITS = KEY_HALF = 16
DIGITS = 3
#: Rows a slot-numbering cell holds, about.
CELL_ROWS = 2048
#: Sorts after every hex digit: prefix + END lies behind all keys with the prefix.
END = "g"


def with_keys(docs: DataFrame, text: str = "text", row_id: str = "doc_id", overhead: int = 16) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and ``overhead``) and the sort key ``_key``."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "size": F.octet_length(body).cast("long") + overhead,
            "_key": F.concat(
                F.substring(F.md5(body.cast("binary")), 1, KEY_HALF),
                F.substring(F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")), 1, KEY_HALF),
            ),
        }
    )


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = 0.005) -> list[str]:
    """The ``shards - 1`` boundaries; a row lies right of each boundary not above its key.

    The driver holds the open ranges' histograms only: at most ``shards`` times 4,096 rows.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    splitters: dict[int, str] = {}
    open_at = {i: ("", 0) for i in range(1, shards)} if total else {}  # splitter: prefix, bytes below it
    while open_at:
        depth = len(next(iter(open_at.values()))[0])
        prefixes = sorted({p for p, _ in open_at.values()})
        rows = keyed if depth == 0 else keyed.filter(F.substring("_key", 1, depth).isin(prefixes))
        counted = (
            rows.groupBy(F.substring("_key", 1, depth + DIGITS).alias("probe"))
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
            .collect()
        )
        within: dict[str, list] = {}
        for r in sorted(counted, key=lambda r: r["probe"]):
            within.setdefault(r["probe"][:depth], []).append(r)
        still = {}
        for i, (prefix, below) in open_at.items():
            goal, probes = i * total / shards, within[prefix]
            edges = list(accumulate((r["bytes"] for r in probes), initial=below))
            k = min(range(len(edges)), key=lambda k: abs(edges[k] - goal))
            holder = next((j for j in range(len(probes)) if edges[j + 1] > goal), len(probes) - 1)
            final = depth + DIGITS >= 2 * KEY_HALF or probes[holder]["n"] == 1
            if final or abs(edges[k] - goal) <= allowed:
                splitters[i] = prefix if k == 0 else probes[k - 1]["probe"] + END
            else:
                still[i] = (probes[holder]["probe"], edges[holder])
        open_at = still
    return [splitters[i] for i in sorted(splitters)]


def assign(keyed: DataFrame, shards: int, tolerance: float = 0.005) -> DataFrame:
    """``keyed`` with ``shard`` and ``slot``, which is gapless from 0 within a shard.

    ``keyed`` is read several times, so give a cut or stored table. Slots follow
    the key order by cells of about ``CELL_ROWS`` rows: a cell's first slot is the
    count of the cells before it. A cell above a thousandth of all rows is a group
    of copies and is cut further along the ids.
    """
    splitters = find_splitters(keyed, shards, tolerance)
    n = keyed.count()
    digits = max(1, math.ceil(math.log(max(2, n / CELL_ROWS), 16)))
    cell = F.substring("_key", 1, digits)
    hot_rows = max(4 * CELL_ROWS, n // 1000)
    hot = [r[0] for r in keyed.groupBy(cell).count().filter(F.col("count") > hot_rows).collect()]  # 1,000 at most
    finer = F.concat(cell, F.substring("_key", KEY_HALF + 1, digits + 1))
    shard = F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s <= F.col("_key"))) if splitters else F.lit(0)
    placed = keyed.withColumns(
        {"shard": shard.cast("int"), "_cell": F.when(cell.isin(hot), finer).otherwise(cell) if hot else cell}
    )
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_cell")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("shard", "_cell").orderBy("_key")
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(starts, ["shard", "_cell"])
        .withColumn("slot", (F.col("_start") + F.col("_at") - 1).cast("long"))
        .drop("_cell", "_at", "_start")
    )


def write_shards(docs: DataFrame, path: str, shards: int, tolerance: float = 0.005) -> None:
    """The documents as one folder a shard (``shard=0`` and so on)."""
    placed = assign(with_keys(docs), shards, tolerance).drop("_key", "size")
    placed.repartition("shard", F.col("slot") % 64).write.partitionBy("shard").parquet(path)
