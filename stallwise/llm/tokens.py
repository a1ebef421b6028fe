"""Tokens of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Its inverse modulo 2**64, by Newton's iteration.
_inv = int(_P)
for _ in range(6):
    _inv = _inv * (2 - int(_P) * _inv) % (1 << 64)
_P_INV = np.uint64(_inv)

#: Bytes that end a word: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word's letters: a-z, the apostrophe and all of non-ASCII characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), ord("'"), *range(0x80, 0x100)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: list[str | None], chars: int = 2_000_000) -> list[tuple[int, int]]:
    """Bounds of consecutive runs of about ``chars`` characters, for bounded work memory; a longer text is a run."""
    return runs_of([len(t or "") for t in texts], chars)


def runs_of(lengths: list[int], chars: int) -> list[tuple[int, int]]:
    """As ``runs``, from the texts' lengths."""
    out, start, held = [], 0, 0
    for i, n in enumerate(lengths):
        held += n + 1
        if held >= chars:
            out.append((start, i + 1))
            start, held = i + 1, 0
    return [*out, (start, len(lengths))] if start < len(lengths) else out


class Tokens:
    """The tokens of ``texts``, A-Z lower-cased.

    ``doc`` has each token's text number, ``starts`` and ``ends`` its bytes in
    ``data``. With ``letters`` tokens are runs of letters, else of all that is not
    white space. Texts are joined by line ends, so no token crosses two texts.
    """

    def __init__(self, texts: list[str | None], letters: bool = False):
        parts = [(t or "").encode("utf-8").lower() for t in texts]
        self.data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        inside = LETTER[self.data] if letters else ~SPACE[self.data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.doc = (np.searchsorted(at, self.starts, side="right") - 1).astype(np.int64)
        self.n_docs = len(parts)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each token's bytes and length."""
        if not len(self):
            return np.empty(0, np.uint64)
        n = len(self.data)
        powers = np.multiply.accumulate(np.full(n, _P, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers)))
        inverse = np.multiply.accumulate(np.full(n, _P_INV, np.uint64))
        own = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix64(own + mix64((self.ends - self.starts).astype(np.uint64)))

    def prefixes(self, longest: int) -> list[np.ndarray]:
        """Hashes of the first 1, 2, ... ``longest`` bytes (of the whole token where it is shorter)."""
        out, h = [], np.zeros(len(self), np.uint64)
        for k in range(longest):
            at = self.starts + k
            here = at < self.ends
            byte = self.data[np.minimum(at, len(self.data) - 1)].astype(np.uint64) + np.uint64(1)
            h = np.where(here, h * _P + byte, h)
            out.append(mix64(h + np.uint64(k + 1)))
        return out
