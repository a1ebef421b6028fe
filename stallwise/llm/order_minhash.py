"""Document fingerprints by Order MinHash.

A text's k-mers are its windows of ``k`` code points (a shorter text is one
window), numbered by occurrence, so that the repeats of a k-mer differ. For each
of ``slots`` hash functions the ``length`` numbered k-mers of smallest hash are
selected, put back in their text order, and hashed as a tuple. Two texts agree in
a slot when they share those k-mers in that order, so the share of equal slots
falls with their edit distance and not only with their k-mer sets.

Null and empty texts have no k-mer and the all-zero fingerprint; two of them are
alike (1), one of them and any other text are not (0). Equal texts have equal
fingerprints. Of k-mers with equal hashes the earlier in the text is selected. Very long texts are
hashed whole, in time and memory in proportion to their length. Repeated rows each give a row, in the order
of their texts where ids are equal. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.tokens import mix64

K, SLOTS, LENGTH = 6, 64, 2
_SEEDS = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
#: Elements of the k-mer by slot matrix that are held at once.
BLOCK = 1 << 20


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """A 32-bit hash of each k-mer with its occurrence number, in text order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(1, len(points) - k + 1)
    if not len(points):
        return np.empty(0, np.uint32)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(points))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n] + np.uint64(1)
    h = mix64(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - first
    return (mix64(h + occurrence * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def signature(text: str | None, k: int = K) -> np.ndarray:
    """The fingerprint's slots."""
    x = numbered_kmers(text or "", k)
    n = len(x)
    if not n:
        return np.zeros(SLOTS, np.uint32)
    odd, shift = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _SEEDS.astype(np.uint32)
    chosen = np.empty((SLOTS, min(LENGTH, n)), np.int64)
    step = max(1, BLOCK // n)
    for s in range(0, SLOTS, step):
        ranks = x[None, :] * odd[s : s + step, None]
        ranks ^= shift[s : s + step, None]
        rows = np.arange(len(ranks))
        for j in range(chosen.shape[1]):
            at = ranks.argmin(axis=1)
            chosen[s : s + step, j] = at
            ranks[rows, at] = np.uint32(0xFFFFFFFF)
    chosen.sort(axis=1)
    h = _SEEDS.copy()
    for j in range(chosen.shape[1]):
        h = mix64(h * np.uint64(31) + x[chosen[:, j]].astype(np.uint64) + np.uint64(1))
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def to_text(slots: np.ndarray) -> str:
    return slots.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots; 0 where just one text was empty."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``: 8 hex digits a slot (a column of that name is replaced)."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([to_text(signature(t)) for t in texts.to_pylist()], pa.string())

    return docs.withColumn("fingerprint", run(F.col(text)))


def with_next(docs: DataFrame, parts: int, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt so that each part holds a range of ids in order, and then the row that follows it.

    The parts' edges are quantiles of the ids, found from the ids alone; the first
    row of each part (of the first part for the last) is copied to the part before.
    The columns are ``_part``, ``_ahead`` (a copy), ``doc_id`` and ``text``. Rows
    are ordered by id, nulls first, then by text; the rows of one id (all null ids
    are one) are in one part, as nothing else tells which of them comes first.
    """
    ids = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edges = np.array(sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) or []}), np.int64)

    @F.arrow_udf("int")
    def part_of(column: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, column.to_numpy(zero_copy_only=False)).astype(np.int32))

    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = ids.withColumn("_key", key).withColumn("_part", part_of("_key"))
    # the smallest id of each part that has rows: ``parts`` rows at most, so a broadcast of them is bounded
    heads = sorted((r["_part"], r["id"]) for r in rows.groupBy("_part").agg(F.min("_key").alias("id")).collect())
    before = [(head, part, last) for (part, head), (last, _) in zip(heads, [*heads[-1:], *heads])]
    ahead = docs.sparkSession.createDataFrame(before, "_key long, _part int, _before int")
    to = F.array(F.struct("_part", F.lit(False).alias("_ahead")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("_part"), F.lit(True).alias("_ahead"))))
    dealt = rows.join(F.broadcast(ahead), ["_key", "_part"], "left").withColumn("_to", F.explode(F.array_compact(to)))
    return (
        dealt.select("_to._part", "_to._ahead", "doc_id", "text")
        .repartitionById(max(1, len(edges) + 1), F.col("_part"))
        .sortWithinPartitions("_part", "_ahead", F.col("doc_id").asc_nulls_first(), "text")
    )


def against_next(docs: DataFrame, parts: int, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness, and that to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def row(now, following, ahead_sig):
            doc_id, body, sig = now
            changed = edited(body, following)
            other = signature(changed)
            sha = hashlib.sha256(changed.encode("utf-8")).hexdigest()
            return doc_id, len(body), sha, to_text(sig), to_text(other), likeness(sig, other), likeness(sig, ahead_sig)

        for batch in batches:
            for part, ahead, doc_id, body in zip(*(batch[c].to_pylist() for c in ("_part", "_ahead", "doc_id", "text"))):
                sig = signature(body)
                if held is not None and held[0] == part:
                    rows.append(row(held[1], body, sig))
                held = None if ahead else (part, (doc_id, body, sig))
            if rows:
                yield _batch(rows)
                rows = []

    return with_next(docs, parts, row_id, text).mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
