"""Byte-level BPE encoding and decoding of whole texts.

A text of up to ``chunk_chars`` code points is one chunk, whose pieces the tokenizer
library finds and encodes in one call. A longer one is cut, in one pass over it, into
chunks that overlap their successor by ``overlap`` code points; the chunks are dealt
over the cluster and pre-tokenised in parallel. The pattern looks ahead but never
behind, so two pre-tokenisations that share one boundary agree from there on:
neighbouring chunks are stitched at the first boundary both have inside their overlap.
Chunks without such a boundary (one pre-token longer than the overlap) are joined and
pre-tokenised as one segment. The pieces between two stitches are then encoded, each
piece on its own. A stitch never follows white space, whose pieces depend on what comes
next, so the pieces are those of the whole text.

Null and empty texts give an empty list of ids. Rows are never merged: repeated
ids or texts each give a row. An empty table gives an empty result. Very long
texts take time in proportion to their length, over many tasks. There are no ties: of
equal merges the leftmost of the lowest rank is first, as in the library. A column of
``docs`` that is called like a result column is replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.memory import give_back
from stallwise.session import cut_lineage

#: Longest look-ahead of the pattern; boundaries closer to a cut are not trusted.
LOOKAHEAD = 3
#: Texts of a batch that are Python strings at once.
ROWS = 256
#: Pieces of long texts that a worker keeps, about 200 bytes each.
CACHED_PIECES = 100_000

_codecs: dict = {}


def load_ranks(path: str) -> bytes:
    """The rank file's bytes, read once on the driver (under 1 MB for 50,000 ids) and shipped with the job."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """One worker's pre-tokeniser, encoder and id table."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = [b""] * (max(table.values(), default=-1) + 1)
        for piece, rank in table.items():
            self.bytes_of[rank] = piece

    def encode(self, segment: str) -> np.ndarray:
        """The ids of a segment's pieces."""
        return self.encoder.encode_to_numpy(segment, disallowed_special=()).astype(np.int32)

    def encode_pieces(self, pieces: list[str]) -> np.ndarray:
        """The ids of pieces, each encoded by itself; pieces recur, so up to ``CACHED_PIECES`` are kept."""
        known, out = self.pieces, []
        if len(known) > CACHED_PIECES:
            known.clear()
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self.encoder._encode_single_piece(piece)
            out += ids
        return np.array(out, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec(ranks, pattern: str) -> Codec:
    data = ranks.value
    key = (len(data), hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _whole(df: DataFrame, text: Column, ranks, pattern: str) -> DataFrame:
    @F.arrow_udf("array<int>")
    def encode_text(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks, pattern)
        return _lists([codec.encode(t or "") for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()])

    return df.withColumn("ids", encode_text(text))


def _whole_and_back(df: DataFrame, text: Column, ranks, pattern: str) -> DataFrame:
    """As ``_whole``, with ``decoded``: the ids are decoded where they are made, so that a task needs one worker and not two."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def there_and_back(texts: pa.Array) -> pa.Array:
        codec, ids, decoded = _codec(ranks, pattern), [], []
        for i in range(0, len(texts), ROWS):
            own = [codec.encode(t or "") for t in texts.slice(i, ROWS).to_pylist()]
            ids.append(_lists(own))
            # one text's ids at a time become Python numbers
            decoded.append(pa.array((codec.decode(a.tolist()) for a in own), pa.binary()))
        del own
        give_back()
        both = [_joined(ids, pa.list_(pa.int32())), _joined(decoded, pa.binary())]
        return pa.StructArray.from_arrays(both, ["ids", "decoded"])

    return df.withColumn("_both", there_and_back(text)).withColumns({"ids": F.col("_both.ids"), "decoded": F.col("_both.decoded")})


def _chunked(df: DataFrame, text: str, keep: list[str], ranks, pattern: str, size: int, overlap: int) -> DataFrame:
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        """The chunks of each text, each with its overlap."""
        return pa.array(([t[i : i + size + overlap] for i in range(0, len(t), size)] for t in texts.to_pylist()), pa.list_(pa.string()))

    @F.arrow_udf("array<int>")
    def piece_ends(bodies: pa.Array) -> pa.Array:
        """Where each piece of a chunk ends; of a piece that ends in white space, negative."""
        out = []
        for body in bodies.to_pylist():
            pieces = _codec(ranks, pattern).find(body)
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
            out.append(np.where([p[-1].isspace() for p in pieces], -ends, ends).astype(np.int32))
        return _lists(out)

    @F.arrow_udf("array<int>")
    def encode_part(bodies: pa.Array, ends: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        """The ids of each chunk's pieces from a stitch up to the next chunk's."""
        codec, out = _codec(ranks, pattern), []
        for body, own, lo, hi in zip(bodies.to_pylist(), ends.to_pylist(), starts.to_pylist(), stops.to_pylist()):
            edges = [lo, *(abs(e) for e in own if abs(e) > lo and (hi is None or abs(e) <= hi))]
            out.append(codec.encode_pieces([body[a:b] for a, b in zip(edges, edges[1:])]))
        return _lists(out)

    def encode_joined(group: pa.Table) -> pa.Table:
        codec = _codec(ranks, pattern)
        rows = list({r["_chunk"]: r for r in sorted(group.to_pylist(), key=lambda r: r["_chunk"])}.values())
        base = rows[0]["_chunk"] * size
        hi = None if rows[-1]["_to"] is None else rows[-1]["_to"] - base
        whole = "".join([r["_body"][:size] for r in rows[:-1]] + [rows[-1]["_body"]])
        ids = codec.encode(whole[rows[0]["_from"] - base : hi])
        return pa.table({"_row": [rows[0]["_row"]], "_segment": [rows[0]["_segment"]], "_ids": _lists([ids])})

    same = [F.col(c) for c in dict.fromkeys([*keep, text])]
    rows = df.withColumn("_row", F.concat(F.hex(F.xxhash64(F.lit(0), *same)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *same))))
    chunks = rows.select("_row", F.posexplode(cut(F.col(text))).alias("_chunk", "_body")).repartition("_row", "_chunk")
    chunks = cut_lineage(chunks.withColumn("_ends", piece_ends("_body")))
    trusted = F.filter("_ends", lambda e: (e >= size) & (e <= size + overlap - LOOKAHEAD))
    near = F.concat(F.array(F.lit(0)), F.filter("_ends", lambda e: (e > 0) & (e < overlap)))

    start = F.col("_chunk") * size
    of_text = Window.partitionBy("_row").orderBy("_chunk")
    synced = (
        chunks.select(
            "_row",
            "_chunk",
            F.transform(near, lambda e: e + start).alias("_head"),
            F.transform(trusted, lambda e: e + start).alias("_tail"),
        )
        .dropDuplicates(["_row", "_chunk"])
        .withColumn("_sync", F.array_min(F.array_intersect(F.lag("_tail").over(of_text), "_head")))
        .withColumn("_from", F.when(F.col("_chunk") == 0, F.lit(0)).otherwise(F.col("_sync")))
        .withColumn("_to", F.lead("_sync").over(of_text))
        .withColumn("_segment", F.count("_from").over(of_text))
        .withColumn("_chunks", F.count("*").over(Window.partitionBy("_row", "_segment")))
        .select("_row", "_chunk", "_from", "_to", "_segment", "_chunks")
    )
    placed = chunks.join(synced, ["_row", "_chunk"])
    single = placed.filter("_chunks = 1").select(
        "_row", "_segment", encode_part("_body", "_ends", F.col("_from") - start, F.col("_to") - start).alias("_ids")
    )
    joined = (
        placed.filter("_chunks > 1")
        .groupBy("_row", "_segment")
        .applyInArrow(encode_joined, "_row string, _segment bigint, _ids array<int>")
    )
    parts = F.array_sort(F.array_distinct(F.collect_list(F.struct("_segment", "_ids"))))
    ids = single.unionByName(joined).groupBy("_row").agg(F.flatten(parts["_ids"]).alias("ids"))
    return rows.select("_row", *keep).join(ids, "_row").select(*keep, "ids")


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    keep: list[str] | None = None,
    chunk_chars: int = 32_768,
    overlap: int = 256,
    decoded: bool = False,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default), ``ids array<int>`` and, if asked for, what ``decode`` adds."""
    if chunk_chars <= 2 * overlap or overlap <= LOOKAHEAD:
        raise ValueError("chunk_chars must exceed twice the overlap, and the overlap the pattern's look-ahead")
    made = ["ids", "decoded"] if decoded else ["ids"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    rows = docs.select(*dict.fromkeys([*keep, text]))
    is_long = F.coalesce(F.length(text), F.lit(0)) > chunk_chars
    short = (_whole_and_back if decoded else _whole)(rows.filter(~is_long), F.col(text), ranks, pattern).select(*keep, *made)
    long = _chunked(rows.filter(is_long), text, keep, ranks, pattern, chunk_chars, overlap)
    return short.unionByName(decode(long, ranks_path, pattern) if decoded else long)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded binary``: the concatenated raw bytes of its ids (null ids: no bytes)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        codec = _codec(ranks, pattern)
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        # one text's ids at a time become Python numbers
        return pa.array((codec.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])), pa.binary())

    return encoded.withColumn("decoded", bytes_of(F.col(ids)))
