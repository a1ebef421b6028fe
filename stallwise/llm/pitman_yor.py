"""Language-model scores by a hierarchical Pitman-Yor model.

Every token is a customer of the restaurant of its context: the word before it, of
a text's first token the end token. Every word has its restaurant. The tables of
the context restaurants are customers of one shared parent restaurant, whose base is
uniform over the known words and one unknown. A dish's tables are sampled given all
else (blocked Gibbs steps: by the exact distribution with generalised Stirling
numbers up to ``EXACT`` customers, beyond that by seating blocks of customers),
first in the contexts, then in the parent; after ``burn_in`` sweeps the predictive
probabilities of each sweep's seating are averaged. Each sweep's probabilities of all
known words and the unknown one sum to 1. A text's score is the sum of the logarithms.

Documents are cut in blocks, and a block sends each of its distinct dishes (word and
context) once, with its customers, in blobs to hash shards; a row is sent for shards
that a block has dishes of, so there are never more rows than dishes. A word's dishes
are in one shard; those of the words that have ``frequent_share`` of all training
tokens, at most ``1/frequent_share``, are dealt by word and context. Words that have ``coded_share``
of all training tokens travel as their place in a shared list. The dealt table is
stored by shard, so that the passes over it move no dish again:

1. each shard counts the customers of its contexts, and one table a dish;
2. in each of ``turns`` turns, given the whole restaurants' sums, each shard samples its
   dishes' tables;
3. given the sums of the last turn's tables, each shard samples the same tables anew (the
   generators are its own) and sends back one logarithm a dish, which blocks sum up.

All counts are exact, and no result depends on how the rows are partitioned.

Null and empty texts are one end token. Repeated rows each count and each get a
row. With no training token all counts are 0 and the probabilities uniform. An empty
table gives an empty result. A text is never cut: one longer than ``BLOCK_CHARS`` is a block
of its own. There are no ties to break. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.tokens import Tokens, mix64, runs, runs_of
from stallwise.session import cut_lineage, stored_by

END = np.uint64(0x5EED0FE7D0C5)
EXACT = 64
#: Characters of the corpus a shard stands for, and of a block of documents.
SHARD_CHARS = 16_000_000
BLOCK_CHARS = 4_000_000
DEALT = "shard int, block bigint, ids array<bigint>, lengths binary, words binary, sizes binary, contexts binary, customers binary, docs binary, times binary"
#: What shards ask of the contexts' and the frequent words' home shards, and the answers; a shard of -1 is for the driver.
ASKED = "home int, shard int, contexts binary, customers binary, tables binary, frequent binary, rare binary"
TOTALS = "turn int, shard int, home int, customers binary, tables binary, frequent binary, rare binary"
VALUES = "home int, block bigint, shard int, sizes binary, logs binary, counts binary"


@dataclass
class Settings:
    """Discounts and strengths of the context restaurants and of their parent, and the sampler's turns and sweeps."""

    discount: float = 0.8
    strength: float = 1.0
    parent_discount: float = 0.85
    parent_strength: float = 1.0
    turns: int = 2
    burn_in: int = 2
    sweeps: int = 3
    seed: int = 7
    frequent_share: float = 1 / 65_536
    coded_share: float = 1 / (1 << 20)


@dataclass
class Corpus:
    """What all tasks share: training tokens, known words, the frequent words, sorted, with their counts, and the words that have a code."""

    n: int
    known: int
    words: np.ndarray
    counts: np.ndarray
    coded: np.ndarray


@dataclass
class Parent:
    """Of each sweep the parent's customers and the weight of a new dish, and the frequent words' probabilities and customers there."""

    customers: np.ndarray
    opening: np.ndarray
    p: np.ndarray
    frequent: np.ndarray


@dataclass
class Shard:
    """A shard's dishes: ``word`` and ``context`` number ``words`` and ``contexts``, ``dish`` has the sent dishes' numbers."""

    words: np.ndarray
    contexts: np.ndarray
    word: np.ndarray
    context: np.ndarray
    c: np.ndarray
    dish: np.ndarray


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of the texts, each text with its end token, and their text numbers."""
    parts = [_stream(texts[a:b], a) for a, b in runs(texts)]
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _stream(texts: list[str | None], first: int) -> tuple[np.ndarray, np.ndarray]:
    tokens = Tokens(texts)
    own = tokens.counts()
    h, doc = np.empty(len(tokens) + len(texts), np.uint64), np.repeat(np.arange(first, first + len(texts)), own + 1)
    h[np.cumsum(own + 1) - 1] = END
    h[np.arange(len(tokens)) + tokens.doc] = tokens.hashes()
    return h, doc


def find(sorted_words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash among the words, -1 where it is none."""
    if not len(sorted_words):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_words, h), len(sorted_words) - 1)
    return np.where(sorted_words[at] == h, at, -1)


def context_of(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each token, of a text's first token ``END``."""
    out = np.concatenate((h[:0], [END], h[:-1])).astype(np.uint64)[: len(h)]
    out[1:][doc[1:] != doc[:-1]] = END
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)


def home_of(block: int, shards: int) -> int:
    """The shard that a block's documents and sums meet in."""
    return int(mix64(np.array([block], np.uint64))[0] % np.uint64(shards))


def summed(words: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and the sums of their counts."""
    kinds, number = np.unique(words, return_inverse=True)
    return kinds, np.bincount(number, times, len(kinds)).astype(np.int64)


def joined(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def pack(words: np.ndarray, corpus: Corpus) -> bytes:
    """Hashes in little room: the coded words' places, and then the hashes of the others."""
    at = find(corpus.coded, words) + 1
    codes = squeeze(at)
    return len(codes).to_bytes(4, "little") + codes + words[at == 0].tobytes()


def unpack(blobs: list[bytes], corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of several ``pack`` results, and each hash's place among them."""
    ends = [4 + int.from_bytes(b[:4], "little") for b in blobs]
    codes = expand([b[4:e] for b, e in zip(blobs, ends)])
    others = np.concatenate([np.frombuffer(b[e:], np.uint64) for b, e in zip(blobs, ends)])
    used = np.flatnonzero(np.bincount(codes, minlength=len(corpus.coded) + 1)[1:])
    kinds = np.union1d(corpus.coded[used], others)
    places = np.concatenate(([0], np.searchsorted(kinds, corpus.coded))).astype(np.int32)
    out = places[codes]
    out[codes == 0] = np.searchsorted(kinds, others)
    return kinds, out


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in little room: as narrow as they fit, the bytes of one place beside each other."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    planes = x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + zlib.compress(planes.tobytes(), 1)


def expand(blobs: list[bytes]) -> np.ndarray:
    """The numbers of ``squeeze``."""
    parts = [np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(b[0], -1).T.copy().view(f"u{b[0]}").ravel() for b in blobs]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def rows_table(rows: list[tuple], schema: str) -> pa.Table:
    """``rows`` as a table of the named columns."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    names = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array(v, kinds[k]) for (n, k), v in zip(names, zip(*rows) if rows else [()] * len(names))})


def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), c and t up to ``n``."""
    log_s = np.full((n + 1, n + 1), -np.inf)
    log_s[1, 1] = 0.0
    t = np.arange(n + 1)
    for c in range(1, n):
        stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + log_s[c]
        log_s[c + 1] = np.logaddexp(np.concatenate(([-np.inf], log_s[c][:-1])), stay)
    return log_s


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers."""
    z = x + 8
    shifted = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) - np.log(shifted)


def log_gamma_large(x: np.ndarray) -> np.ndarray:
    """The same of numbers from 8 on."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


class LargeStirling:
    """Logarithms of the generalised Stirling numbers S(c, t) for c above ``EXACT``, up to a term of c alone.

    Up to 1.8 c^discount tables it is the series over j of C(t, j) Γ(c - dj) / Γ(-dj), beyond
    that the saddle point of the generating function (1 - (1 - x)^d)^t, whose error there is below 2 %
    and nearly the same for neighbouring t.
    """

    TERMS = 80

    def __init__(self, discount: float) -> None:
        d = self.d = discount
        j = np.arange(1, self.TERMS + 1)
        whole = np.abs(d * j - np.rint(d * j)) < 1e-9
        self.size = np.array([-np.inf if w else -math.lgamma(-d * k) for k, w in zip(j.tolist(), whole.tolist())])
        self.sign = np.where((j + np.ceil(d * j)) % 2 == 0, 1.0, -1.0)
        y = np.concatenate((np.linspace(math.log(1e-80), math.log(0.5), 60_000), np.log1p(-np.exp(np.linspace(math.log(0.5), math.log(1e-7), 20_000)))[1:]))
        self.log_y = y
        self.log_share = np.log(-np.expm1(d * y)) - np.log(-np.expm1(y)) - math.log(d) - (d - 1) * y

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of whole ``c`` and ``t``, 1 to c."""
        z, out = t / c**self.d, np.empty(len(c))
        edges = ((0.0, 0.1, 8), (0.1, 0.5, 16), (0.5, 1.1, 36), (1.1, 1.8, self.TERMS))
        for low, high, terms in edges:
            w = np.flatnonzero((z >= low) & (z < high))
            if len(w):
                out[w] = self.series(c[w], t[w], terms)
        w = np.flatnonzero(z >= 1.8)
        out[w] = self.saddle(c[w], t[w])
        out -= t * math.log(self.d) + log_gamma(t + 1.0)
        # where all sit alone, or all but two
        alone = -log_gamma(c)
        out = np.where(t == c, alone, out)
        return np.where(t == c - 1, alone + np.log((1 - self.d) * c * (c - 1) / 2), out)

    def series(self, c: np.ndarray, t: np.ndarray, terms: int) -> np.ndarray:
        j = np.arange(1, terms + 1)
        gamma = log_gamma_large(np.maximum(c[:, None] - self.d * np.arange(terms + 1), 8.0))
        ratio = gamma[:, 1:] - gamma[:, :1]
        left = t[:, None] - np.arange(terms)
        choose = np.cumsum(np.log(np.maximum(left, 1e-300)) - np.log(j), axis=1)
        size = np.where(left > 0, ratio + choose + self.size[:terms], -np.inf)
        top = size.max(axis=1)
        return top + np.log(np.maximum((np.exp(size - top[:, None]) * self.sign[:terms]).sum(axis=1), 1e-300))

    def saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        d = self.d
        log_y = np.interp(np.log(t / c), self.log_share, self.log_y)
        y, x, g = np.exp(log_y), -np.expm1(log_y), -np.expm1(d * log_y)
        slope = x * d * y ** (d - 1) / g
        bend = t * x * slope * (1 / x + (1 - d) / y - d * y ** (d - 1) / g)
        # both forms leave out Γ(c)
        return np.log(c) + t * np.log(g) - c * np.log1p(-y) - 0.5 * np.log(2 * math.pi * np.maximum(bend, 1e-12))


def typical_tables(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """About the most likely number of tables: that where a Pitman-Yor restaurant of some strength, seen so far, opens tables with weight ``a``."""
    low, high = np.full(len(c), math.log(1e-9)), np.log(a + 2.0)
    for _ in range(18):
        mid = (low + high) / 2
        theta = np.exp(mid) - d
        weight = log_gamma(theta + 1) - log_gamma(theta + d) + d * np.log(theta + c + (d - 1) / 2)
        more = weight < np.log(np.maximum(a, 1e-300))
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return np.clip((a - np.exp(low) + d) / d, 1, c)


@lru_cache(maxsize=8)
def large_stirling(discount: float) -> LargeStirling:
    return LargeStirling(discount)


def seat_large(c: np.ndarray, a: np.ndarray, log_s: LargeStirling, rng: np.random.Generator) -> np.ndarray:
    """A sample of the tables of dishes with more than ``EXACT`` customers, from the weights a^t S(c, t).

    Where opening has little weight, the tables but the first are nearly Poisson, and where it
    has much, nearly normal with the weights' own mode and curvature: such proposals are taken
    or left by the weights (independence samplers).
    """
    c, a = c.astype(float), np.maximum(a, 1e-300)
    t = np.empty(len(c), np.int64)
    for low, high, steps in ((0.0, 3.0, 3), (3.0, 12.0, 6)):
        w = np.flatnonzero((a >= low) & (a < high))
        if len(w):
            rate = a[w] / log_s.d if low == 0 else np.maximum(typical_tables(c[w], a[w], log_s.d) - 0.5, 1.0)
            t[w] = _seat_few(c[w], a[w], rate, log_s, rng, steps)
    w = np.flatnonzero(a >= 12)
    if len(w):
        t[w] = _seat_many(c[w], a[w], typical_tables(c[w], a[w], log_s.d), log_s, rng)
    return t


def _seat_few(c: np.ndarray, a: np.ndarray, rate: np.ndarray, log_s: LargeStirling, rng: np.random.Generator, steps: int) -> np.ndarray:
    shift = np.log(a / rate)
    # the weights over those of the proposal
    more = lambda w, t: log_s(c[w], t) + t * shift[w] + log_gamma(t)
    t = np.minimum(1.0 + rng.poisson(rate), c)
    now = more(np.arange(len(c)), t)
    for _ in range(steps):
        other = np.minimum(1.0 + rng.poisson(rate), c)
        moved = np.flatnonzero(other != t)
        then = more(moved, other[moved])
        take = np.log(rng.random(len(moved))) < then - now[moved]
        t[moved[take]], now[moved[take]] = other[moved[take]], then[take]
    return t.astype(np.int64)


def _seat_many(c: np.ndarray, a: np.ndarray, typical: np.ndarray, log_s: LargeStirling, rng: np.random.Generator, steps: int = 6) -> np.ndarray:
    weight = lambda t: t * np.log(a) + log_s(c, t)
    middle = np.clip(np.rint(typical), 2, c - 1)
    for _ in range(2):  # to the weights' own mode
        low, at, high = weight(middle - 1), weight(middle), weight(middle + 1)
        bend = np.maximum(2 * at - low - high, 1e-6)
        middle = np.clip(np.rint(middle + np.clip((high - low) / 2 / bend, -middle / 2, middle)), 2, c - 1)
    width = 1.2 / np.sqrt(bend) + 0.7
    log_q = lambda t: -0.5 * ((t - middle) / width) ** 2
    t = middle.copy()
    now = weight(t) - log_q(t)
    for _ in range(steps):
        other = np.rint(middle + width * rng.standard_normal(len(c)))
        inside = (other >= 1) & (other <= c)
        other = np.where(inside, other, t)
        then = weight(other) - log_q(other)
        take = inside & (np.log(rng.random(len(c))) < then - now)
        t, now = np.where(take, other, t), np.where(take, then, now)
    return t.astype(np.int64)


def seat(c: np.ndarray, a: np.ndarray, discount: float, log_s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A sample of the tables of dishes with ``c`` customers, ``a`` the weight of opening one."""
    t = np.minimum(c, 1).astype(np.int64)
    log_a, u = np.log(np.maximum(a, 1e-300)), rng.random(len(c))
    first = np.minimum(c, EXACT)
    order = np.argsort(first, kind="stable")
    edges = np.searchsorted(first[order], np.arange(2, EXACT + 2))
    for m in range(2, EXACT + 1):
        rows = order[edges[m - 2] : edges[m - 1]]
        if len(rows):
            w = log_s[m, 1 : m + 1] + np.arange(1, m + 1) * log_a[rows, None]
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[rows] = 1 + (w < u[rows, None] * w[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(c > EXACT)
    if len(rows):
        t[rows] = seat_large(c[rows], a[rows], large_stirling(discount), rng)
    return t


def parent_of(guests: np.ndarray, frequent: np.ndarray, rare: np.ndarray, corpus: Corpus, s: Settings, turn: int) -> Parent:
    """The parent of each sweep, from all tables of the contexts, those of the frequent words and the rare words' parent tables.

    The frequent words' tables and the weight of opening one, which counts them, are sampled in turns.
    """
    rng = np.random.default_rng((s.seed, 1 << 32, turn))
    seats = stirling(s.parent_discount)
    opened = lambda tables: (s.parent_strength + s.parent_discount * (rare + tables.sum(axis=1))) / (corpus.known + 1)
    tables = np.minimum(frequent, 1)
    for _ in range(5):
        weight = opened(tables)
        tables = np.array([seat(f, np.full(len(f), a), s.parent_discount, seats, rng) for f, a in zip(frequent, weight)]).reshape(frequent.shape)
    opening = opened(tables)
    p = (frequent - s.parent_discount * tables + opening[:, None]) / (s.parent_strength + guests[:, None])
    return Parent(guests.astype(float), opening, p, frequent)


def sample(shard: Shard, tables: np.ndarray, corpus: Corpus, parent: Parent, s: Settings, seed: int, turn: int):
    """In a turn before the last one sweep's, in the last each kept sweep's tables of a shard's dishes, and its words' customers and tables in the parent.

    ``tables`` are the whole restaurants' of the shard's contexts, ``parent`` is the
    state before the first sweep. Of a frequent word a shard has a part of the customers:
    to the tables that they open it adds what the others' opened before, by their share.
    """
    rng, sweeps = np.random.default_rng((s.seed, seed, turn)), s.sweeps if turn == s.turns else 1
    below, above = stirling(s.discount), stirling(s.parent_discount)
    n_words = len(shard.words)
    at = find(corpus.words, shard.words)
    hot = at >= 0
    many = np.flatnonzero(shard.c > 1)
    c, word = shard.c[many], shard.word[many]
    room = (s.strength + s.discount * tables)[shard.context[many]]
    once = np.bincount(shard.word, shard.c == 1, n_words).astype(np.int64)
    t = np.minimum(shard.c, 1).astype(np.int64)
    customers = np.bincount(shard.word, shard.c, n_words)
    p_word = customers / max(1, corpus.n)
    p_word[hot] = parent.p[0][at[hot]]
    elsewhere = np.zeros(n_words, np.int64)
    elsewhere[hot] = np.rint(parent.frequent[0][at[hot]] * (1 - customers[hot] / np.maximum(corpus.counts[at[hot]], 1))).astype(np.int64)
    open_parent = np.full(n_words, parent.opening[0])
    for sweep in range(s.burn_in + sweeps):
        t[many] = seat(c, room * p_word[word], s.discount, below, rng)
        guests = once + np.bincount(word, t[many], n_words).astype(np.int64)
        own = seat(guests + elsewhere, open_parent, s.parent_discount, above, rng)
        p_word = (guests + elsewhere - s.parent_discount * own + parent.opening[0]) / (s.parent_strength + parent.customers[0])
        if sweep >= s.burn_in:
            yield t.copy(), guests, own


def predict(shard: Shard, seatings, customers: np.ndarray, tables: np.ndarray, corpus: Corpus, parent: Parent, s: Settings) -> np.ndarray:
    """The dishes' predictive probabilities, averaged over the sweeps' seatings.

    ``customers`` and ``tables`` (of each sweep) are the whole restaurants'.
    """
    at = find(corpus.words, shard.words)
    whole = (s.strength + customers)[shard.context]
    out = np.zeros(len(shard.c))
    for k, (t, guests, own) in enumerate(seatings):
        p_word = (guests - s.parent_discount * own + parent.opening[k]) / (s.parent_strength + parent.customers[k])
        p_word[at >= 0] = parent.p[k][at[at >= 0]]
        room = (s.strength + s.discount * tables[k])[shard.context]
        out += (shard.c - s.discount * t + room * p_word[shard.word]) / whole
    return out / s.sweeps


def vocabulary(docs: DataFrame, s: Settings, shards: int) -> Corpus:
    """Training tokens, known words, the frequent words and the coded ones (``1/coded_share`` at most), from sums over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t, out in zip(batch["text"].to_pylist(), batch["held_out"].to_pylist()) if not out]
            parts = [np.unique(stream(texts[a:b])[0], return_counts=True) for a, b in runs(texts)]
            if parts:
                words, times = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                shard = shard_of(words, shards)
                rows = [(k, words[shard == k].tobytes(), times[shard == k].astype(np.uint32).tobytes()) for k in np.unique(shard).tolist()]
                yield from rows_table(rows, "shard int, words binary, counts binary").to_batches()

    def add(group: pa.Table) -> pa.Table:
        words, times = summed(joined(group["words"].to_pylist(), np.uint64), joined(group["counts"].to_pylist(), np.uint32))
        keep = times >= min(s.frequent_share, s.coded_share) * times.sum()  # a part of the tokens, so none of these words is missed
        return rows_table([(int(times.sum()), len(words), words[keep].tobytes(), times[keep].tobytes())], "n bigint, known bigint, words binary, counts binary")

    counted = docs.select("text", "held_out").mapInArrow(count, "shard int, words binary, counts binary")
    found = cut_lineage(counted.groupBy("shard").applyInArrow(add, "n bigint, known bigint, words binary, counts binary"))
    n, known = (int(x or 0) for x in found.agg(F.sum("n"), F.sum("known")).first())

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = joined(batch["words"].to_pylist(), np.uint64), joined(batch["counts"].to_pylist(), np.int64)
            keep = times >= max(1.0, min(s.frequent_share, s.coded_share) * n)
            yield from rows_table([(words[keep].tobytes(), times[keep].tobytes())], "words binary, counts binary").to_batches()

    rows = list(found.select("words", "counts").mapInArrow(trim, "words binary, counts binary").toLocalIterator())
    words, counts = joined([bytes(r["words"]) for r in rows], np.uint64), joined([bytes(r["counts"]) for r in rows], np.int64)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    own = counts >= s.frequent_share * n
    return Corpus(n, known, words[own], counts[own], words)


def deal(docs: DataFrame, shared, shards: int) -> DataFrame:
    """Blocks of documents: a header with each dish's documents, and one row a shard with the block's dishes in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus: Corpus = shared.value
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, chars = batch["doc_id"].to_pylist(), pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()
            out = np.array([bool(x) for x in batch["held_out"].to_pylist()], bool)
            for a, b in runs_of(chars, BLOCK_CHARS):
                h, doc = stream(batch["text"].slice(a, b - a).to_pylist())
                before, train = context_of(h, doc), ~out[a:b][doc]
                key = np.where(find(corpus.words, h) >= 0, mix64(h ^ mix64(before)), h)
                order = np.lexsort((before, h, shard_of(key, shards)))
                hs, bs, ss = h[order], before[order], shard_of(key[order], shards)
                new_word = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])))
                new_dish = new_word | np.concatenate(([True], bs[1:] != bs[:-1]))
                first = np.flatnonzero(new_dish)
                c = np.add.reduceat(train[order].astype(np.uint32), first, dtype=np.uint32)
                word_at = np.flatnonzero(new_word[first])
                sizes = np.diff(np.append(word_at, len(first))).astype(np.uint32)
                words, contexts, of_dish, of_word = hs[first][word_at], bs[first], ss[first], ss[first][word_at]
                name = part * (1 << 32) + number
                number += 1
                lengths, times = squeeze(np.bincount(doc, minlength=b - a)), squeeze(np.diff(np.append(first, len(h))))
                rows = [(home_of(name, shards), name, ids[a:b], lengths, None, None, None, None, squeeze(doc[order]), times)]
                for k in np.unique(of_dish).tolist():
                    d, w = slice(*np.searchsorted(of_dish, (k, k + 1))), slice(*np.searchsorted(of_word, (k, k + 1)))
                    rows.append((k, name, None, None, pack(words[w], corpus), squeeze(sizes[w]), pack(contexts[d], corpus), squeeze(c[d]), None, None))
                yield from rows_table(rows, DEALT).to_batches()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, DEALT)


def read_shard(group: pa.Table, corpus: Corpus) -> tuple[list[dict], Shard]:
    """A shard's rows, in the order of their blocks, and their dishes."""
    rows = sorted(group.select(["block", "shard", "words", "sizes", "contexts", "customers"]).to_pylist(), key=lambda r: r["block"])
    sizes = [expand([r["sizes"]]) for r in rows]
    words, word = unpack([r["words"] for r in rows], corpus)
    contexts, key = unpack([r["contexts"] for r in rows], corpus)
    key = np.repeat(word, np.concatenate(sizes)) * np.int64(len(contexts)) + key
    order = np.argsort(key, kind="stable")  # the blocks' rows are sorted already
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    dish = np.empty(len(key), np.int32)
    dish[order] = np.cumsum(new) - 1
    key = key[new]
    c = np.bincount(dish, expand([r["customers"] for r in rows])).astype(np.int64)
    return rows, Shard(words, contexts, (key // len(contexts)).astype(np.int32), (key % len(contexts)).astype(np.int32), c, dish)


def read_totals(totals: pa.Table, turn: int, contexts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole restaurants' customers, and their tables in each sweep of a turn, of a shard's contexts."""
    order = np.argsort(shard_of(contexts, shards), kind="stable")
    rows = sorted((r for r in totals.to_pylist() if r["turn"] == turn), key=lambda r: r["home"])
    customers = np.empty(len(contexts), np.int64)
    customers[order] = expand([r["customers"] for r in rows])
    parts = [expand([r["tables"]]) for r in rows]
    sizes = [len(expand([r["customers"]])) for r in rows]
    tables = np.concatenate([p.reshape(-1, n) for p, n in zip(parts, sizes) if n], axis=1) if len(contexts) else np.empty((1, 0))
    out = np.empty(tables.shape)
    out[:, order] = tables
    return customers, out


def ask(shard: Shard, number: int, tables: list[np.ndarray], rare: list[int], corpus: Corpus, shards: int) -> pa.Table:
    """A shard's customers and tables (of each sweep) of each of its contexts, and its tables of the frequent words."""
    home = shard_of(shard.contexts, shards)
    order = np.argsort(home, kind="stable")
    ends = np.cumsum(np.bincount(home, minlength=shards))
    n = len(shard.contexts)
    customers = np.bincount(shard.context, shard.c, n)[order]
    own = np.stack([np.bincount(shard.context, t, n)[order] for t in tables])
    at = find(corpus.words, shard.words)[shard.word]
    hot = at >= 0
    frequent = np.stack([np.bincount(at[hot], t[hot], len(corpus.words)) for t in tables]).astype(np.uint32)
    rows = []
    for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
        words = frequent[:, k::shards]
        if hi > lo or words.any() or not k:
            tables_of = squeeze(own[:, lo:hi].ravel())
            rows.append((k, number, pack(shard.contexts[order][lo:hi], corpus), squeeze(customers[lo:hi]), tables_of, squeeze(words.ravel()), np.array(rare if not k else [0] * len(tables), np.int64).tobytes()))
    return rows_table(rows, ASKED)


def total(group: pa.Table, corpus: Corpus, turn: int) -> pa.Table:
    """The sums over all shards, for each shard's contexts in the order it sent them, and for the driver."""
    rows = sorted(group.to_pylist(), key=lambda r: r["shard"])
    asked = [expand([r["customers"]]) for r in rows]
    tables = [expand([r["tables"]]).reshape(-1, len(c)) if len(c) else None for r, c in zip(rows, asked)]
    _, number = unpack([r["contexts"] for r in rows], corpus)
    rare = sum(np.frombuffer(r["rare"], np.int64) for r in rows)
    sweeps = len(rare)
    customers = np.bincount(number, np.concatenate(asked))
    sums = np.stack([np.bincount(number, np.concatenate([t[k] for t in tables if t is not None] or [asked[0]])) for k in range(sweeps)])
    cuts = np.cumsum([len(c) for c in asked])[:-1]
    home = rows[0]["home"]
    out = [(turn, r["shard"], home, squeeze(customers[own]), squeeze(sums[:, own].ravel()), None, None) for r, own in zip(rows, np.split(number, cuts)) if len(own)]
    frequent = sum(expand([r["frequent"]]) for r in rows)
    return rows_table([*out, (turn, -1, home, None, squeeze(sums.sum(axis=1)), squeeze(frequent), rare.tobytes())], TOTALS)


def gather_totals(totals: DataFrame, corpus: Corpus, sweeps: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tables, the frequent words' tables (``1/frequent_share`` words at most) and the rare words' parent tables, of each sweep."""
    guests, rare = np.zeros(sweeps, np.int64), np.zeros(sweeps, np.int64)
    frequent = np.zeros((sweeps, len(corpus.words)), np.int64)
    for r in totals.filter("shard < 0").toLocalIterator():
        guests += expand([r["tables"]])
        rare += np.frombuffer(r["rare"], np.int64)
        frequent[:, r["home"] :: shards] += expand([r["frequent"]]).reshape(sweeps, -1)
    return guests, frequent, rare


def score_shard(group: pa.Table, totals: pa.Table, corpus: Corpus, before: Parent, after: Parent, shards: int, s: Settings) -> pa.Table:
    """For each block the logarithms of its dishes' probabilities, and its words' counts."""
    rows, shard = read_shard(group, corpus)
    _, tables = read_totals(totals, s.turns - 1, shard.contexts, shards)
    seatings = sample(shard, tables[0], corpus, before, s, rows[0]["shard"], s.turns)
    p = predict(shard, seatings, *read_totals(totals, s.turns, shard.contexts, shards), corpus, after, s)
    at = find(corpus.words, shard.words)
    seen = np.bincount(shard.word, shard.c).astype(np.int64)
    seen[at >= 0] = corpus.counts[at[at >= 0]]
    logs, out, start = np.log10(p).astype(np.float32), [], 0
    for r in rows:
        sizes = expand([r["sizes"]])
        own = shard.dish[start : start + int(sizes.sum())]
        start += len(own)
        of_word = shard.word[own[np.cumsum(sizes) - sizes]]
        out.append((home_of(r["block"], shards), r["block"], r["shard"], r["sizes"], logs[own].tobytes(), squeeze(seen[of_word])))
    return rows_table(out, VALUES)


def gather_blocks(headers: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of some blocks with their sums."""
    blocks = values["block"].to_numpy()
    return pa.concat_tables([_gather(h, values.filter(pa.array(blocks == h["block"])).to_pylist()) for h in headers.to_pylist()])


def _gather(head: dict, values: list[dict]) -> pa.Table:
    rows = sorted(values, key=lambda r: r["shard"])
    lengths, doc, times = (expand([head[c]]) for c in ("lengths", "docs", "times"))
    d = len(lengths)
    logs = np.repeat(joined([r["logs"] for r in rows], np.float32).astype(float), times)
    seen = np.repeat(np.repeat(expand([r["counts"] for r in rows]), expand([r["sizes"] for r in rows])), times)
    return pa.table({
        "doc_id": pa.array(head["ids"], pa.int64()),
        "n_tokens": lengths,
        "n_known": np.bincount(doc[seen > 0], minlength=d).astype(np.int64),
        "log_counts": np.bincount(doc, np.log10(seen + 1.0), d),
        "score": np.bincount(doc, logs, d),
    })


def score(docs: DataFrame, held_out: Column, s: Settings | None = None) -> DataFrame:
    """One row a document: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    The model learns from the rows that ``held_out`` does not hold for.
    """
    s = s or Settings()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    shards = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / SHARD_CHARS))
    corpus = vocabulary(rows, s, shards)
    shared = spark.sparkContext.broadcast(corpus)

    def count_shard(group: pa.Table) -> pa.Table:
        _, shard = read_shard(group, shared.value)
        return ask(shard, group["shard"][0].as_py(), [np.minimum(shard.c, 1)], [0], shared.value, shards)

    def sampler(parent, turn: int):
        def sample_shard(group: pa.Table, totals: pa.Table) -> pa.Table:
            _, shard = read_shard(group, shared.value)
            _, tables = read_totals(totals, turn - 1, shard.contexts, shards)
            number = group["shard"][0].as_py()
            seatings = list(sample(shard, tables[0], shared.value, parent.value, s, number, turn))
            own = find(shared.value.words, shard.words) < 0
            return ask(shard, number, [t for t, _, _ in seatings], [int(w[own].sum()) for _, _, w in seatings], shared.value, shards)

        return sample_shard

    def summed_up(asked: DataFrame, turn: int) -> DataFrame:
        return cut_lineage(asked.groupBy("home").applyInArrow(lambda group: total(group, shared.value, turn), TOTALS))

    with stored_by(deal(rows, shared, shards), "shard", shards) as dealt:
        dishes = dealt.filter("ids IS NULL").select("shard", "block", "words", "sizes", "contexts", "customers").groupBy("shard")
        totals = summed_up(dishes.applyInArrow(count_shard, ASKED), 0)
        guests, frequent, _ = gather_totals(totals, corpus, 1, shards)
        after = spark.sparkContext.broadcast(parent_of(guests, frequent, np.array([max(0, corpus.known - len(corpus.words))]), corpus, s, 0))
        for turn in range(1, s.turns + 1):
            own, before = totals.filter("shard >= 0"), after
            asked = dishes.cogroup(own.groupBy("shard")).applyInArrow(sampler(before, turn), ASKED)
            totals = summed_up(asked, turn)
            sums = gather_totals(totals, corpus, s.sweeps if turn == s.turns else 1, shards)
            after = spark.sparkContext.broadcast(parent_of(*sums, corpus, s, turn))
        both = own.unionByName(totals.filter("shard >= 0"))
        values = dishes.cogroup(both.groupBy("shard")).applyInArrow(
            lambda left, right: score_shard(left, right, shared.value, before.value, after.value, shards, s), VALUES
        )
        headers = dealt.filter("ids IS NOT NULL").select("shard", "block", "ids", "lengths", "docs", "times")
        out = headers.groupBy("shard").cogroup(values.groupBy("home")).applyInArrow(
            gather_blocks, "doc_id bigint, n_tokens bigint, n_known bigint, log_counts double, score double"
        )
        out = cut_lineage(out)
    base = F.col("log_counts") - F.col("n_tokens") * math.log10(corpus.n + corpus.known + 1)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(corpus.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
