"""The prefix trie of conversations: which first turns they share, and what sharing saves.

A conversation is the sequence of its turns' digests. The sequences are sorted over the
cluster, so each part (a shard) holds a contiguous piece of the trie. A shard writes its
piece as balanced parentheses in depth-first order: a parenthesis opens where a sequence
leaves its predecessor and closes where its successor leaves it. Over the parentheses'
excess lies a range min-max tree: the least excess of blocks, and of pairs of blocks
above them. ``findclose`` climbs it until a block goes below the node's own excess and
descends to the first place that does; that delimits each subtree. The leaf pairs ``()``
up to a place, the conversations that end up to a node and the bytes up to a node are
cumulative arrays, so leaves, members and savings of a subtree are differences of ranks.

Nodes on the path that a shard shares with the shard before or after (its spines) are
known in part only. They are exchanged by the digest of their path and merged: counts
and savings add up, since a shard counts the first sight of a node, a child or a leaf
only where neighbours do not show it earlier (or later, for leaves). All other nodes stay
where they were made. What a task holds is one shard: ``SHARD_TURNS`` turns, or the parts
the session shuffles with if they are more, and no less than one conversation's digests,
24 bytes a turn; texts are not held. The digest over a node's own conversations is
a running hash: a spine's ids come as one string a shard, in order.

Rows without a conversation id belong to none and are left out. Null roles and texts
are empty. Turns are ordered by number, null first, and those of one number by digest.
Repeated rows are turns of their own. An empty table gives an empty result. Columns of
the input other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.session import cut_lineage

SHARD_TURNS = 1 << 18
KEY_BYTES = 16
#: Parentheses a block of the range min-max tree.
BLOCK = 64
NODE = (
    "shard long, at long, parent long, parent_spine boolean, conv_id long, parent_conv_id long, depth long, n_convs long, "
    "n_children long, n_leaves long, saved long, ends_sha256 string, key string, parent_key string, ends string"
)
FIGURES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes for a role and a text; different turns differ."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, KEY_BYTES)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order: the digest of each and the UTF-8 bytes of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_digest(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("turn")
    )
    ordered = F.sort_array(F.collect_list("turn"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share; -1 where one is null."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(a.isNull() | b.isNull(), -1).when(differs > 0, differs - 1).otherwise(F.size(a)).cast("long")


def find_close(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each opening parenthesis the place of its closing one, by the range min-max tree of ``excess``."""
    blocks = -(-len(excess) // BLOCK)
    padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
    padded[: len(excess)] = excess
    levels = [padded.reshape(blocks, BLOCK).min(axis=1)]
    while len(levels[-1]) > 1:
        least = levels[-1]
        if len(least) % 2:
            least = levels[-1] = np.append(least, np.iinfo(np.int64).max)
        levels.append(least.reshape(-1, 2).min(axis=1))
    goal, close = excess[opens] - 1, np.full(len(opens), -1)

    def scan(who: np.ndarray, start: np.ndarray) -> None:
        """Look for the goal from ``start`` to the end of its block."""
        for _ in range(BLOCK):
            who, start = who[close[who] < 0], start[close[who] < 0]
            if not len(who):
                return
            hit = padded[start] == goal[who]
            close[who[hit]] = start[hit]
            start = start + 1
            inside = ~hit & (start % BLOCK != 0)
            who, start = who[inside], start[inside]

    scan(np.arange(len(opens)), opens + 1 - ((opens + 1) % BLOCK == 0))
    who = np.flatnonzero(close < 0)
    at, up = (opens[who] + 1) // BLOCK, np.zeros(len(who), dtype=np.int64)
    at += (opens[who] + 1) % BLOCK != 0
    down = np.zeros(len(who), dtype=bool)
    while len(who):
        least = np.empty(len(who), dtype=np.int64)
        for level in np.unique(up):
            here = up == level
            least[here] = levels[level][at[here]]
        low = least <= goal[who]
        down |= low
        ends = low & (up == 0)
        scan(who[ends], at[ends] * BLOCK)
        # a block that goes low is entered by its first half; one that does not is passed, upwards where it was a second half
        deeper, over = low & ~ends, ~low
        at[deeper], up[deeper] = at[deeper] * 2, up[deeper] - 1
        at[over] += 1
        climb = over & ~down & (at % 2 == 0)
        at[climb], up[climb] = at[climb] // 2, up[climb] + 1
        who, at, up, down = who[~ends], at[~ends], up[~ends], down[~ends]
    return close


def shared_with_previous(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many first turns each sequence shares with the one before it."""
    lengths = np.diff(offsets)
    lcp = np.zeros(len(lengths), dtype=np.int64)
    open_ = np.arange(1, len(lengths))
    depth = 0
    while len(open_):
        open_ = open_[(lengths[open_] > depth) & (lengths[open_ - 1] > depth)]
        open_ = open_[(keys[offsets[open_] + depth] == keys[offsets[open_ - 1] + depth]).all(axis=1)]
        depth += 1
        lcp[open_] = depth
    return lcp


def least_of_ranges(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first:last]`` for each pair; no range is empty."""
    rows = [values]
    while 2 ** len(rows) <= len(values):
        half = 2 ** (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    level = np.frexp((last - first).astype(float))[1] - 1
    out = np.empty(len(first), dtype=np.int64)
    for k in np.unique(level):
        w = level == k
        out[w] = np.minimum(rows[k][first[w]], rows[k][last[w] - 2**k])
    return out


def encode_shard(convs: np.ndarray, keys: np.ndarray, nbytes: np.ndarray, offsets: np.ndarray, shard: int, before: int, after: int) -> dict[str, list]:
    """The nodes of a shard's sorted sequences; ``before`` and ``after`` are the turns shared with its neighbours (-1: none)."""
    lengths, lcp = np.diff(offsets), shared_with_previous(keys, offsets)
    fresh = lengths - lcp
    closing = np.append((lengths[:-1] - lcp[1:]), lengths[-1] + 1)
    counts = np.stack([fresh, closing], axis=1).ravel()
    counts[0] += 1  # the root
    bits = np.repeat(np.tile([1, -1], len(convs)), counts)
    excess = np.cumsum(bits)
    opens = np.flatnonzero(bits > 0)
    close = find_close(excess, opens)
    n = len(opens)
    depth, node = excess[opens] - 1, np.arange(n)
    end = node + (close - opens + 1) // 2  # the subtree is node .. end - 1

    leaf_pair = np.append((bits[:-1] > 0) & (bits[1:] < 0), False)
    if after >= lengths[-1]:
        leaf_pair[opens[-1]] = False  # the next shard tells whether this node is a leaf
    leaves = np.append(0, np.cumsum(leaf_pair))
    ends_at = np.cumsum(fresh)
    own_ends = np.bincount(ends_at, minlength=n)
    members = np.append(0, np.cumsum(own_ends))
    n_convs = members[end] - members[node]
    conv_id = least_of_ranges(convs, members[node], members[end])
    by_depth = depth * (n + 1) + node
    ordered = np.sort(by_depth)
    above = np.searchsorted(ordered, (depth - 1) * (n + 1) + node) - 1
    parent = np.where(depth > 0, ordered[np.maximum(above, 0)] % (n + 1), -1)
    first_seen = node > before
    children = np.bincount(parent[1:][first_seen[1:]], minlength=n)
    within = np.arange(len(nbytes)) - np.repeat(offsets[:-1], lengths)
    size = np.append(0, nbytes[within >= np.repeat(lcp, lengths)])
    saved = np.append(0, np.cumsum((n_convs - first_seen) * size))

    last_path = close >= len(bits) - (lengths[-1] + 1)
    spine = (node <= before) | (last_path & (depth <= after))
    names: dict[int, str] = {}
    for v in np.flatnonzero(spine):
        i = members[v]  # a sequence with this path
        path = keys[offsets[i] + depth[v] - 1].tobytes() if depth[v] else b""
        names[v] = hashlib.sha256(names[parent[v]].encode() + path).hexdigest() if depth[v] else "root"
    ids = convs.tolist()
    texts = [",".join(map(str, ids[members[v] : members[v] + own_ends[v]])) for v in range(n)]
    parents = parent.tolist()
    return {
        "shard": [shard] * n, "at": node.tolist(), "parent": parents, "parent_spine": [p >= 0 and bool(spine[p]) for p in parents],
        "conv_id": conv_id.tolist(), "parent_conv_id": [None if p < 0 else int(conv_id[p]) for p in parents], "depth": depth.tolist(), "n_convs": n_convs.tolist(),
        "n_children": children.tolist(), "n_leaves": (leaves[close] - leaves[opens]).tolist(), "saved": (saved[end] - saved[node]).tolist(),
        "ends_sha256": [None if v in names else hashlib.sha256(t.encode()).hexdigest() for v, t in enumerate(texts)],
        "key": [names.get(v) for v in range(n)], "parent_key": [names.get(p) if v in names else None for v, p in enumerate(parents)],
        "ends": [t if v in names else None for v, t in enumerate(texts)],
    }


def encoded(paths: DataFrame) -> DataFrame:
    """The nodes of all shards (``NODE``); those with a ``key`` are parts of a node that several shards see."""
    spark = paths.sparkSession
    turns = paths.agg(F.sum(F.size("turns"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    order = [F.col("turns.key"), F.col("conv_id")]
    sorted_ = cut_lineage(paths.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_shard", F.spark_partition_id())
    edges = sorted_.groupBy("_shard").agg(F.min("turns.key").alias("_first"), F.max("turns.key").alias("_last"))
    along = Window.orderBy("_shard")
    edges = edges.select("_shard", common(F.lag("_last").over(along), F.col("_first")).alias("_before"), common(F.col("_last"), F.lead("_first").over(along)).alias("_after"))
    shared = {r[0]: (r[1], r[2]) for r in edges.collect()}  # two numbers a shard

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        shard = table["_shard"][0].as_py()
        turns = table["turns"].combine_chunks()
        turns = turns if isinstance(turns, pa.ListArray) else turns.chunk(0)
        flat = turns.flatten()
        key = flat.field("key")
        keys = np.frombuffer(b"".join(key.to_pylist()), dtype=np.uint64).reshape(-1, 2) if len(key) else np.zeros((0, 2), dtype=np.uint64)
        lengths = np.array([len(t) for t in turns], dtype=np.int64)
        columns = encode_shard(table["conv_id"].to_numpy(), keys, flat.field("bytes").to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths)), shard, *shared[shard])
        for b in pa.table(columns, schema=SCHEMA).to_batches(max_chunksize=10_000):
            yield b

    return sorted_.select("_shard", "conv_id", "turns").mapInArrow(encode, NODE)


SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in NODE.split(", ")])


def running_digests(ends: DataFrame) -> DataFrame:
    """The digest of each ``key``'s ``ends`` strings, joined by commas in the order of the shards, without gathering them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        pair = lambda: pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
        for b in batches:
            for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield pair()
                    key, state = k, hashlib.sha256()
                    state.update(text.encode())
                else:
                    state.update(b"," + text.encode())
        if key is not None:
            yield pair()

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.repartition(parts, "key").sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(run, "key string, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """One row a node of the trie of ``paths`` (``conv_id``, ``turns``), with ``FIGURES``."""
    nodes = cut_lineage(encoded(cut_lineage(paths)))
    parts = nodes.filter("key IS NOT NULL")
    none = hashlib.sha256().hexdigest()
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = parts.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums)
    merged = merged.join(running_digests(parts.filter("ends <> ''")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    merged = cut_lineage(merged)
    known = merged.select("key", F.col("conv_id").alias("parent_conv_id"))
    spines = merged.join(known.withColumnRenamed("key", "parent_key"), "parent_key", "left").select(*FIGURES)
    inner = nodes.filter("key IS NULL")
    places = parts.select("shard", F.col("at").alias("parent"), "key").join(known, "key").drop("key")
    hanging = inner.filter("parent_spine").drop("parent_conv_id").join(places, ["shard", "parent"]).select(*FIGURES)
    return spines.unionByName(inner.filter("NOT parent_spine").select(*FIGURES)).unionByName(hanging)
