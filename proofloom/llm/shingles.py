"""Word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
#: Word hashes a task remembers; the memory is emptied when it is full.
REMEMBERED = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the distinct shingles of texts. Words end at ASCII white space; only A-Z are lower-cased."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. Fewer words than a shingle has: the whole sequence as one. No word: none."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, n = self.known, len(words)
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        k = min(self.words, n)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _ODD + hashes[i:n - k + 1 + i])
        return np.unique(out)
