"""Token counts by a count-only Viterbi search over a unigram vocabulary.

A text's spaces become the mark U+2581, one is put in front where none stands
there, and the text is split before each mark. Within a word an Aho-Corasick
automaton enumerates the vocabulary pieces that end at each position; dynamic
programming carries the best score and its number of pieces, and nothing else: no
back pointers, no pieces. The tie rules are the tokenizer's: of equal scores the
piece that starts first, which is the longest, stays; a character that is no piece
by itself may be passed at the least score less ``UNKNOWN_PENALTY`` and counts one
token a UTF-8 byte.

The vocabulary is given as pieces with scores; it is read on the driver and shared
(tens of thousands of pieces). Words repeat, so each task keeps the counts of up to
``CACHE_WORDS`` words. Null and empty texts have no tokens. Repeated rows each get
a row; columns called like a result column are replaced. An empty table gives an empty
result. Very long texts are counted whole, in time in proportion to their length.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000
#: Longer words are counted without being kept.
CACHED_LENGTH = 64
ROWS = 256

_counters: dict = {}


def load_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a model file, in the order of their ids.

    Control, unknown, unused and byte pieces are no text: a text that holds their names,
    such as ``<s>``, is counted by the letters of the name.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


class Counter:
    """One worker's automaton and the counts of the words it has met."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through a word."""
        scores, counts, singles = [0.0], [0], self.singles
        best, pieces, at = None, 0, 0  # of the paths to position ``at + 1`` so far
        for last, (length, score) in self.automaton.iter(word):  # by end, the longest first
            while at < last:
                if word[at] not in singles:
                    best, pieces = self.passed(word[at], best, pieces, scores[at], counts[at])
                scores.append(best)
                counts.append(pieces)
                best = None
                at += 1
            start = last + 1 - length
            path = score + scores[start]
            if best is None or path > best:
                best, pieces = path, counts[start] + 1
        for char in word[at:]:
            if char not in singles:
                best, pieces = self.passed(char, best, pieces, scores[-1], counts[-1])
            scores.append(best)
            counts.append(pieces)
            best = None
        return counts[-1], scores[-1]

    def passed(self, char: str, best: float | None, pieces: int, before: float, count: int) -> tuple[float, int]:
        """The better of the paths by pieces and of passing a character that is none, which starts last and so loses ties."""
        path = self.unknown + before
        return (path, count + len(char.encode("utf-8"))) if best is None or path > best else (best, pieces)

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, tokens and score of a text."""
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", MARK)
        words = (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]
        cache, tokens, total = self.cache, 0, 0.0
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words:
            found = cache.get(w)
            if found is None:
                found = self.word(MARK + w)
                if len(w) <= CACHED_LENGTH:
                    cache[w] = found
            tokens += found[0]
            total += found[1]
        return len(words), tokens, total


def _counter(pieces) -> Counter:
    value = pieces.value
    key = (len(value), hash(tuple(value)))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(value)
    return _counters[key]


def count(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_tokens`` and ``token_score``, the best path's score."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint,token_score:double>")
    def run(texts: pa.Array) -> pa.Array:
        counter = _counter(shared)
        out = [counter.text(t or "") for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()]
        words, tokens, scores = zip(*out) if out else ((), (), ())
        columns = [pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_tokens", "token_score"])

    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens", "token_score", "_counts")]
    return docs.withColumn("_counts", run(F.col(text))).select(*kept, "_counts.*")
