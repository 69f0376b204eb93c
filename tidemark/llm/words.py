"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
SHINGLE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word; forgets all of them when there are very many."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        if len(self) >= self.MOST:
            self.clear()
        if len(word) < 64:
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text: runs of letters, digits and underscores, in lower case."""
        return np.array(list(map(self.__getitem__, WORD.findall((text or "").lower()))), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in order, repeats included."""
    if n < 1 or len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            h = mix(h * _MIX + words[i : len(words) - n + 1 + i])
    return h
