"""Quality rules: base rules, then divergence from the document's language reference.

A reference holds, for one value of ``lang``, the profile of character classes
(each class's median share over all documents of that language, so that a minority
of odd documents does not move it) and the histogram of common words over all its
words. A document is rejected when the Jensen-Shannon distance (base 2, 0 to 1)
between its own histogram and the reference's is above a limit. Short texts have
noisy histograms: each comparison asks for a least number of characters or words,
the word limit falls with the logarithm of the number of words down to a floor (set above
the distances of labelled good documents of each length), and a language without enough text has no
reference. What is not compared is kept.

Common words are those with at least ``common_share`` of all words. A first pass
reports the words with half that share of a batch of documents. Where a word is not
reported it has less than half the share, so its reported count bounds its exact
one; the words that can still be common, ``2 / common_share`` at most however many
batches there are, are counted exactly by a second pass. No full vocabulary is
shuffled, and a reference has ``1 / common_share`` words at most.

Null texts have no words and fail the base rules, as empty ones do. A null
``lang`` is a language of its own. Repeated rows are judged one by one and all
count for the references. An empty table gives an empty result. Columns called
like a result column are replaced. Very long texts are counted whole. There are no ties to
break: words of equal counts are all common, or all not.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.session import cut_lineage

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Steps in which the shares of character classes are counted.
STEPS = 1_000
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
#: Not part of a word when words are counted for the histograms.
MARKS = b"\"'`()[]{}.,:;!?#*$%&|<>"

STATS = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "class_distance:double,word_distance:double>"
)


@cache
def _class_of() -> np.ndarray:
    """The class number of every code point."""
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    by_category = {"Ll": "lower", "Lu": "upper", "Nd": "digit", "Po": "stop", "Pd": "stop", "Zs": "space"}
    for cp in range(0x30000):
        if name := by_category.get(unicodedata.category(chr(cp))):
            table[cp] = CLASSES.index(name)
    for chars, name in ((SYMBOLS + "!@\\^~=+_", "symbol"), (SPACES, "space")):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    return table


def class_counts(text: str) -> np.ndarray:
    return np.bincount(_class_of()[np.frombuffer(text.encode("utf-32-le"), "<u4")], minlength=len(CLASSES))


def plain_words(text: bytes) -> list[bytes]:
    """Words without marks, A-Z lower-cased."""
    return text.lower().translate(None, MARKS).split()


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in repeated windows of five."""
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(SPACES):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered_to = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 5 - max(i, covered_to)
                covered_to = i + 5
    return n, word_chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms with mass."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def _gather(df: DataFrame, common_share: float, least_chars: int, chosen) -> DataFrame:
    """(lang, word, n) of each batch: with ``chosen`` those words' counts, else the words frequent in the batch.

    A null word carries the language's words in ``n``; one of a byte pair (class, share in
    steps of 1/STEPS) counts the documents that have that share of that class. ``batch_words``
    are all words of the batch that reports a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = chosen.value if chosen is not None else None
        for batch in batches:
            words: dict = defaultdict(Counter)
            shares: Counter = Counter()
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if text:
                    words[lang].update(plain_words(text.encode("utf-8")))
                    if wanted is None and len(text) >= least_chars:
                        steps = np.rint(class_counts(text) * (STEPS / len(text))).astype(int).tolist()
                        shares.update((lang, c, step) for c, step in enumerate(steps))
            if wanted is None:
                total = sum(c.total() for c in words.values())
                least = common_share / 2 * total
                rows = [(lang, None, None, None, c.total(), 0) for lang, c in words.items()]
                rows += [(lang, None, c, step, n, 0) for (lang, c, step), n in shares.items()]
                rows += [(lang, w, None, None, n, total) for lang, c in words.items() for w, n in c.items() if n >= least]
            else:
                rows = [(lang, w, None, None, c[w], 0) for lang, c in words.items() for w in wanted.get(lang, ()) if w in c]
            columns = zip(*rows) if rows else [()] * 6
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            names = ["lang", "word", "class", "step", "n", "batch_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return df.select("lang", "text").mapInArrow(run, "lang string, word binary, class int, step int, n bigint, batch_words bigint")


def _median_steps(first: DataFrame) -> DataFrame:
    """The median step of each (lang, class); a language and class has ``STEPS`` + 1 rows at most."""
    group = Window.partitionBy("lang", "class")
    counted = first.filter("class IS NOT NULL").withColumns({"_below": F.sum("n").over(group.orderBy("step")), "_all": F.sum("n").over(group)})
    return counted.filter("2 * _below >= _all").groupBy("lang", "class").agg(F.min("step").alias("step"))


def references(docs: DataFrame, common_share: float = 1 / 20_000, least_words: int = 2_000, least_chars: int = 200) -> dict:
    """Per language: class profile, common words with their counts, and all words; from all documents."""
    spark = docs.sparkSession
    first = cut_lineage(
        _gather(docs, common_share, least_chars, None)
        .groupBy("lang", "word", "class", "step")
        .agg(F.sum("n").alias("n"), F.sum("batch_words").alias("batch_words"))
    )
    totals = first.filter("word IS NULL AND class IS NULL")
    everything = totals.agg(F.sum("n")).first()[0] or 0
    enough = totals.filter(F.col("n") >= max(least_words, common_share * everything)).select("lang", "n")  # 1 / common_share rows at most
    refs = {r["lang"]: {"classes": None, "n": r["n"], "words": {}} for r in enough.collect()}
    langs = F.broadcast(enough.select(F.col("lang").alias("_lang")))
    first = first.join(langs, F.col("lang").eqNullSafe(F.col("_lang")), "left_semi")
    for r in _median_steps(first).collect():
        ref = refs[r["lang"]]
        ref["classes"] = np.zeros(len(CLASSES)) if ref["classes"] is None else ref["classes"]
        ref["classes"][r["class"]] = r["step"]
    most = F.col("n") + common_share / 2 * (everything - F.col("batch_words"))
    candidates: dict = defaultdict(list)
    for r in first.filter("word IS NOT NULL").filter(most >= common_share * everything - 1).select("lang", "word").collect():
        candidates[r["lang"]].append(bytes(r["word"]))
    exact = (
        _gather(docs, common_share, least_chars, spark.sparkContext.broadcast(dict(candidates)))
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= common_share * everything)
    )
    for r in sorted(exact.collect(), key=lambda r: (-r["n"], bytes(r["word"]))):
        refs[r["lang"]]["words"][bytes(r["word"])] = r["n"]
    return refs


def judge(
    docs: DataFrame,
    refs: dict | None = None,
    class_limit: float = 0.185,
    word_limit: float = 1.14,
    word_slope: float = 0.092,
    word_floor: float = 0.4,
    least_chars: int = 200,
    least_words: int = 60,
    least_common: int = 20,
) -> DataFrame:
    """``docs`` with the base counts, ``class_distance``, ``word_distance`` (null: not compared), ``base_failed`` and ``kept``."""
    refs = references(docs) if refs is None else refs
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    @F.arrow_udf(STATS)
    def measure(langs: pa.Array, texts: pa.Array) -> pa.Array:
        by_lang = {}
        for k, r in shared.value.items():
            index = {w: i for i, w in enumerate(r["words"])}
            counts = np.array([*r["words"].values(), 0.0])
            counts[-1] = max(0.0, r["n"] - counts.sum())
            by_lang[k] = (r["classes"], index, counts)
        out = []
        for lang, text in zip(langs.to_pylist(), texts.to_pylist()):
            text = text or ""
            data = text.encode("utf-8")
            base = base_counts(text, data)
            class_distance = word_distance = None
            if ref := by_lang.get(lang):
                if len(text) >= least_chars and ref[0] is not None:
                    class_distance = js_distance(class_counts(text).astype(float), ref[0])
                if base[0] >= least_words and len(ref[1]) >= least_common and (words := plain_words(data)):
                    bins = np.bincount([ref[1].get(w, len(ref[1])) for w in words], minlength=len(ref[2]))
                    word_distance = js_distance(bins.astype(float), ref[2])
            out.append((*base, class_distance, word_distance))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance"]
        types = [pa.int64()] * 5 + [pa.float64()] * 2
        columns = list(zip(*out)) if out else [()] * 7
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.withColumn("_stats", measure(F.col("lang").cast("string"), F.col("text"))).select(
        *[c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")],
        "_stats.*",
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    widened = F.greatest(F.lit(word_floor), word_limit - word_slope * F.log(F.greatest("n_words", F.lit(1))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > widened)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)
