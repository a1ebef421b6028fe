"""Toxicity by a linear-chain conditional random field.

The labels are of documents, so the tokens' labels are derived first: a token
feature (the word, or its first 4 to 6 bytes) marks a toxic token when it is seen
in toxic training documents far more than in clean ones, beyond chance; the marked tokens of toxic documents are labelled 1, all others 0. A
two-state linear-chain model with those features, the neighbours' and the state
transitions is then trained on whole documents by its exact gradient, from
forward and backward sums. Scoring runs forward-backward over each whole text and
gives each token's marginal; tokens at 0.5 or more form the spans, and the
document's score is one less the product of the chances of being clean of the tokens
with a marginal of ``FLOOR`` or more, so that a long text does not add up to a toxic
one; without such a token it is the highest marginal, which orders clean texts too.

Training uses at most ``sample`` toxic and twice as many clean labelled documents
(of those with a text of at most ``longest`` characters the smallest by hash of their ids), and at most
``sample_chars`` characters of text in all; scoring covers all rows. Null and empty texts score 0. Without labels of both kinds all
scores are 0. Repeated rows are scored one by one; of contradicting labels of a
document the highest counts. An empty table gives an empty result. Very long texts are tagged
whole, in memory in proportion to their tokens; of training rows with equal hashes the smaller id is first. Columns called like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.memory import give_back
from stallwise.llm.tokens import Tokens, mix64, runs

#: Features are hashed to so many weights.
WEIGHTS = 1 << 21
PREFIXES = (4, 5, 6)
#: Marginals below this do not add up in a document's score; the highest alone counts.
FLOOR = 0.25
#: Shingles of training rows that are kept as a set before they are merged.
RECENT = 1 << 16
#: Characters scored at once; a worker keeps the memory that its largest run took.
RUN_CHARS = 500_000


def _marks(tokens: Tokens) -> list[np.ndarray]:
    """The hashes that can mark a token: of the word, and of its first bytes where it is long enough."""
    word = tokens.hashes()
    prefixes = tokens.prefixes(max(PREFIXES))
    long_enough = [(tokens.ends - tokens.starts) >= k for k in PREFIXES]
    return [word, *(np.where(ok, prefixes[k - 1], word) for k, ok in zip(PREFIXES, long_enough))]


def _slots(tokens: Tokens) -> np.ndarray:
    """The weight numbers of each token's features."""
    marks = _marks(tokens)
    word = marks[0]
    first = np.concatenate(([True], tokens.doc[1:] != tokens.doc[:-1])) if len(tokens) else np.empty(0, bool)
    last = np.roll(first, -1)
    before = np.where(first, np.uint64(1), np.roll(word, 1))
    after = np.where(last, np.uint64(2), np.roll(word, -1))
    features = [*marks, before + np.uint64(3), after + np.uint64(5), np.zeros(len(word), np.uint64)]
    mask = np.uint64(WEIGHTS - 1)
    return np.stack([(mix64(f + np.uint64(977 * i)) & mask).astype(np.int32) for i, f in enumerate(features)])


def _log_odds(weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Each token's log-odds by its features."""
    e = np.zeros(slots.shape[1])
    for own in slots:
        e += weights[own]
    return e


class _Chains:
    """The tokens of several documents, laid out so that all documents step together, longest first."""

    def __init__(self, lengths: np.ndarray):
        begin = np.cumsum(np.concatenate(([0], lengths[:-1]))) if len(lengths) else lengths
        self.order = np.argsort(-lengths, kind="stable")
        self.begin, self.sorted = begin[self.order], lengths[self.order]
        longest = int(self.sorted[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.sorted, -np.arange(1, longest + 1), side="right")

    def marginals(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's chance of state 1, and the pair chances summed over all neighbours.

        ``e`` is the log-odds of state 1 by the token's own features; ``trans`` the
        2x2 log weights. Messages are kept as log-odds, so nothing overflows.
        """
        (t00, t01), (t10, t11) = np.exp(trans).tolist()
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        bounded = lambda x: np.minimum(np.maximum(x, -40), 40)  # noqa: E731 - for a few numbers a third of the time of np.clip
        own = np.zeros(len(self.begin))
        for step, k in enumerate(self.active):
            at = self.begin[:k] + step
            before, own = own[:k], e[at]
            if step:
                r = np.exp(bounded(before))
                own += np.log((t01 + r * t11) / (t00 + r * t10))
            forward[at] = own
        for step in range(len(self.active) - 2, -1, -1):
            k = self.active[step + 1]
            at = self.begin[:k] + step
            after = at + 1
            r = np.exp(bounded(e[after] + backward[after]))
            backward[at] = np.log((t10 + r * t11) / (t00 + r * t01))
        p = forward + backward
        np.clip(p, -40, 40, out=p)
        np.exp(np.negative(p, out=p), out=p)
        p += 1
        return np.divide(1, p, out=p), forward, backward


def _pairs(e, forward, backward, trans, inner) -> np.ndarray:
    """Chances of the four state pairs, summed over neighbouring tokens (``inner``: not the last of a document)."""
    t = np.exp(trans)
    f = forward[:-1][inner]
    b = e[1:][inner]
    b += backward[1:][inner]
    for x in (f, b):
        np.exp(np.clip(x, -40, 40, out=x), out=x)
    mass = t[0, 1] * b
    mass += t[0, 0]
    mass += t[1, 0] * f
    more = t[1, 1] * f
    more *= b
    mass += more
    np.divide(1, mass, out=mass)
    del more
    return t * np.array([[mass.sum(), mass @ b], [mass @ f, (mass * f) @ b]])


def mark_tokens(marks: Iterable[np.ndarray], doc: np.ndarray, toxic: np.ndarray, odds: float = 60.0, chance: float = 0.05) -> np.ndarray:
    """Token labels from document labels, by the marks' document counts.

    A mark is toxic when its smoothed odds are high and its share of toxic
    documents could come about for any one of all marks with a probability of
    ``chance`` at most (Chernoff's bound, against the toxic share of all tokens).
    """
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    rate = min(max(float(toxic[doc].mean()), 1e-6), 1 - 1e-6)
    hit = np.zeros(len(doc), bool)
    for m in marks:
        kinds, number = np.unique(m, return_inverse=True)
        pairs = np.unique(number * len(toxic) + doc)
        in_toxic = toxic[pairs % len(toxic)]
        seen1 = np.bincount(pairs[in_toxic] // len(toxic), minlength=len(kinds))
        seen0 = np.bincount(pairs[~in_toxic] // len(toxic), minlength=len(kinds))
        n = seen1 + seen0
        part = np.clip(seen1 / n, 1e-9, 1 - 1e-9)
        surprise = n * (part * np.log(part / rate) + (1 - part) * np.log((1 - part) / (1 - rate)))
        marked = (part > rate) & (surprise >= np.log(len(kinds) / chance)) & ((seen1 / n1) >= odds * (seen0 + 0.5) / n0)
        hit |= marked[number]
    return hit & toxic[doc]


def _marked(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each token's text number and marks."""
    parts = []
    for a, b in runs(texts, RUN_CHARS):
        tokens = Tokens(texts[a:b], letters=True)
        parts.append([tokens.doc + a, *_marks(tokens)])
    doc, *marks = (np.concatenate([p.pop(0) for p in parts]) for _ in range(2 + len(PREFIXES)))
    return doc, marks


def _slotted(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's text number and weight numbers; there are ``n`` tokens."""
    doc, slots, at = np.empty(n, np.int64), np.empty((len(PREFIXES) + 4, n), np.int32), 0
    for a, b in runs(texts, RUN_CHARS):
        tokens = Tokens(texts[a:b], letters=True)
        doc[at : at + len(tokens)] = tokens.doc + a
        slots[:, at : at + len(tokens)] = _slots(tokens)
        at += len(tokens)
    return doc, slots


def fit(texts: list[str], labels: list[int], steps: int = 80, rate: float = 0.5, l2: float = 1e-4, damp: float = 0.05) -> dict | None:
    """Weights and transitions of the model; None without labels of both kinds or any marked token.

    The marks are made and used before the weight numbers, so that the driver does not hold both.
    ``damp`` keeps the steps of rare features (a neighbour seen once) in proportion to their gradient.
    """
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return None
    doc, marks = _marked(texts)
    y = mark_tokens((marks.pop(0) for _ in range(len(marks))), doc, toxic)
    if not y.any():
        return None
    # a toxic document without any marked token says nothing of its tokens
    told = np.ones(len(texts), bool)
    told[toxic] = np.bincount(doc[y], minlength=len(texts))[toxic] > 0
    y = y[told[doc]].astype(float)
    texts = [t for t, use in zip(texts, told) if use]
    doc, slots = _slotted(texts, len(y))
    chains = _Chains(np.bincount(doc, minlength=len(texts)))
    inner = doc[:-1] == doc[1:]
    del doc
    a, b = y[:-1][inner], y[1:][inner]
    seen = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
    del a, b
    # the used weights numbered in order, by a table of all: sorting the slots takes ten times their memory; other weights stay 0
    number = np.zeros(WEIGHTS, np.int32)
    for own in slots:
        number[own] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used), dtype=np.int32)
    for own in slots:
        own[:] = number[own]
    w, trans = np.zeros(len(used)), np.zeros((2, 2))
    m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
    w[slots[-1][0] if slots.size else 0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for step in range(1, steps + 1):
        e = _log_odds(w, slots)
        p, forward, backward = chains.marginals(e, trans)
        off = np.subtract(p, y, out=p)
        off /= y.sum()
        g = l2 * w
        for own in slots:
            g += np.bincount(own, off, len(w))
        del p, off
        gt = (_pairs(e, forward, backward, trans, inner) - seen) / y.sum() + l2 * trans
        for value, grad, first, second in ((w, g, m, v), (trans, gt, mt, vt)):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + damp)
        del e, forward, backward
    weights = np.zeros(WEIGHTS, np.float32)
    weights[used] = w
    return {"weights": weights, "trans": trans}


def tag(model: dict | None, texts: list[str | None]) -> tuple[np.ndarray, Tokens | None, np.ndarray | None]:
    """Score of each text, the tokens, and each token's chance of being toxic."""
    if model is None:
        return np.zeros(len(texts)), None, None
    tokens = Tokens(texts, letters=True)
    if not len(tokens):
        return np.zeros(len(texts)), tokens, np.empty(0)
    slots = _slots(tokens)
    e = _log_odds(model["weights"], slots)
    p, _, _ = _Chains(tokens.counts()).marginals(e, model["trans"])
    clean = np.log1p(-np.minimum(np.where(p >= FLOOR, p, 0), 1 - 1e-12))
    first = np.flatnonzero(np.concatenate(([True], tokens.doc[1:] != tokens.doc[:-1])))
    highest = np.zeros(tokens.n_docs)
    highest[tokens.doc[first]] = np.maximum.reduceat(p, first)
    return np.maximum(1 - np.exp(np.bincount(tokens.doc, clean, tokens.n_docs)), highest), tokens, p


def training_rows(docs: DataFrame, labels: DataFrame, held_out=None, sample: int = 1_500, sample_chars: int = 8_000_000, longest: int = 10_000) -> list:
    """(text, label) of the bounded training sample, by hash order of the ids; of an id's several texts the least one."""
    fold = F.lit(True) if held_out is None else ~held_out
    short = docs.filter(F.length("text") <= longest).select("doc_id")
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(short, "doc_id", "left_semi")
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    chosen = [known.filter(F.col("toxic") == y).orderBy(*order).limit(sample * (2 - y)).select("doc_id", "toxic") for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 3 * sample rows at most
    texts = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(chosen, "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: mix64(np.array([r["doc_id"] % (1 << 63)], np.uint64))[0])
    return distinct_rows([(r["text"], r["toxic"]) for r in rows], sample_chars)


def distinct_rows(rows: list[tuple[str, int]], sample_chars: int, overlap: float = 0.3) -> list[tuple[str, int]]:
    """The rows up to ``sample_chars`` characters, less near copies of earlier ones, whose every word would seem to mark them."""
    # shingles seen: the last ones as a set, the others as a sorted array of a tenth of its memory
    recent: set[int] = set()
    earlier = np.empty(0, np.int64)
    out, used = [], 0
    for text, label in rows:
        words = text.lower().split()
        shingles = {hash(w) for w in zip(words, words[1:], words[2:])} or {hash(text)}
        fresh = np.fromiter(shingles - recent, np.int64)
        known = len(shingles) - len(fresh)
        if len(earlier):
            at = np.minimum(np.searchsorted(earlier, fresh), len(earlier) - 1)
            known += int((earlier[at] == fresh).sum())
        if known >= overlap * len(shingles):
            continue
        recent |= shingles
        if len(recent) > RECENT:
            earlier = np.union1d(earlier, np.fromiter(recent, np.int64))
            recent = set()
        used += len(text)
        if used > sample_chars:
            break
        out.append((text, label))
    return out


def _spans(texts: list[str | None], tokens: Tokens | None, p: np.ndarray | None) -> list[list[dict]]:
    """Of each text the runs of neighbouring toxic tokens: code point offsets and highest chance."""
    found: list[list[dict]] = [[] for _ in texts]
    if p is None or not len(p):
        return found
    at = np.cumsum([0, *(len((t or "").encode("utf-8")) + 1 for t in texts)])
    chars = np.cumsum((tokens.data & 0xC0) != 0x80)  # characters up to and with each byte
    last = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        own = found[tokens.doc[i]]
        start = int(chars[tokens.starts[i]] - chars[at[tokens.doc[i]]])
        end = start + int(chars[tokens.ends[i] - 1] - chars[tokens.starts[i]]) + 1
        if own and last == i - 1:
            own[-1] |= {"end": end, "p": max(own[-1]["p"], float(p[i]))}
        else:
            own.append({"start": start, "end": end, "p": float(p[i])})
        last = i
    return found


def score(docs: DataFrame, model: dict | None, threshold: float = 0.3, spans: bool = True, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and, if asked for, ``spans``: character offsets and chance of each toxic run."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int,p:double>>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        scores, found = [], []
        for a, b in runs(rows, RUN_CHARS):
            own_scores, tokens, p = tag(shared.value, rows[a:b])
            scores.append(own_scores)
            found += _spans(rows[a:b], tokens, p) if spans else [[]] * (b - a)
            del tokens, p
        give_back()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        values = np.concatenate(scores) if scores else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(values, pa.float64()), pa.array(found, kind)], ["score", "spans"])

    kept = [c for c in docs.columns if c not in ("score", "predicted", "spans", "_toxic")]
    out = docs.withColumn("_toxic", run(F.col(text))).select(*kept, F.col("_toxic.score").alias("score"), F.col("_toxic.spans").alias("spans"))
    out = out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return out if spans else out.drop("spans")
