"""Word hashes and hash mixing for the operators that compare runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_SPACE = re.compile("[ \t-\r]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Distinct words kept by a worker before it starts anew; a bound on memory, not on results.
CACHE = 400_000


def words(text: str | None) -> list[str]:
    """Runs of characters other than the six ASCII white spaces; none for null."""
    if not text:
        return []
    if text.isascii() and not _ODD.search(text) or not _ODD.search(text):
        return text.split()
    return [w for w in _SPACE.split(text) if w]


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = WordHashes()


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def grams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """One hash for each run of ``n`` tokens; none if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = mix(total + h[k : k + m] + np.uint64(seed))
    return total


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a shorter text has the one run of all its words."""
    h = word_hashes(words(text))
    return np.unique(grams(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)
