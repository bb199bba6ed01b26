"""Periodic runs of words, found on harmonic grids.

A run of period p and at least four periods covers the grid points jp, (j+1)p, (j+2)p, (j+3)p for some j. So for each period p the
grid is walked, and where four points in a row have one word, the longest common extensions of jp and (j+1)p forward and
backward give the whole run. Extensions are minima over the LCP arrays of the text's suffix array and of its reverse; a grid point
whose words differ already has no extension to ask for, and a text without a candidate gets no index.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.textwords import words

#: Periods a run must cover, and words it must have.
TIMES, LEAST = 4, 6
#: Texts up to this many words share a table of grid points; questions asked of an index at once. Bounds on memory.
TABLED, ASKED = 1 << 14, 1 << 20

Run = tuple[int, int, int]


@lru_cache(maxsize=4)
def _grid(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points jp with their p, for texts of up to ``most`` words, and jp + 3p, by which they are ordered."""
    at = [np.arange(0, most - (TIMES - 1) * p, p, dtype=np.int32) for p in range(1, (most - 1) // (TIMES - 1) + 1)]
    start, p = np.concatenate(at), np.repeat(np.arange(1, len(at) + 1, dtype=np.int32), [len(a) for a in at])
    order = np.argsort(start + (TIMES - 1) * p, kind="stable")
    start, p = start[order], p[order]
    return start, p, start + (TIMES - 1) * p


def _candidates(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and periods where TIMES points in a row have one word, in pieces of about ASKED."""
    n = len(w)
    if n <= TABLED:
        size = 256
        while size < n:
            size *= 4
        start, p, last = _grid(min(size, TABLED))
        m = np.searchsorted(last, n)
        start, p = start[:m], p[:m]
        for k in range(TIMES - 1):
            same = w[start + k * p] == w[start + (k + 1) * p]
            start, p = start[same], p[same]
        for c in range(0, len(start), ASKED):
            yield start[c : c + ASKED].astype(np.int64), p[c : c + ASKED].astype(np.int64)
        return
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for p in range(1, n // TIMES + 1):
        g = w[::p]
        same = g[1:] == g[:-1]
        j = np.flatnonzero(np.logical_and.reduce([same[k : len(same) - TIMES + 2 + k] for k in range(TIMES - 1)]))
        if len(j):
            held.append((j * p, np.full(len(j), p, np.int64)))
            count += len(j)
        if count >= ASKED:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, count = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def suffix_array(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``w`` and its inverse, by doubling of ranked prefixes."""
    n = len(w)
    rank, step = np.unique(w, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        key = rank * (n + 1) + after
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        rank, step = new, step * 2
        if rank[order[-1]] == n or step >= n:
            return order, rank - 1


def common_prefixes(w: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: words that the suffixes of rank r - 1 and r have in common; 0 for the first."""
    text, before = w.tolist(), np.full(len(w), -1, np.int64)
    before[order[1:]] = order[:-1]
    out, h, n = [0] * len(text), 0, len(text)
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        top = n - max(i, j)
        while h < top and text[i + h] == text[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return np.array(out, np.int32)[order]


class Extensions:
    """Longest common extensions of pairs of positions of a text."""

    def __init__(self, w: np.ndarray):
        order, self.rank = suffix_array(w)
        self.lcp = common_prefixes(w, order, self.rank)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b (different, in range) have in common.

        Minima over ranges of lcp: the table of minima over 2**k entries is built level by level in place, and each pair is
        answered at its own level, so the table never holds more than one level.
        """
        lo, hi = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        by = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[by], np.arange(level.max() + 2)) if len(by) else [0]
        out, table = np.zeros(len(a), np.int64), self.lcp
        for k in range(len(ends) - 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[:-half], table[half:])
            q = by[ends[k] : ends[k + 1]]
            out[q] = np.minimum(table[lo[q]], table[hi[q] - (1 << k) + 1])
        return out


def find_runs(w: np.ndarray) -> list[Run]:
    """All maximal runs of ``w`` (word numbers) as (start, length, smallest period), by start and then period."""
    n, found, index = len(w), np.zeros((0, 3), np.int64), None
    for at, p in _candidates(w):
        if index is None:
            index = Extensions(w), Extensions(w[::-1])
        forward = index[0](at, at + p)
        backward = np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at > 0)
        # Words before jp and (j+1)p, read backwards: the reverse's suffixes at n - jp and n - (j+1)p.
        backward[inner] = index[1](n - at[inner], n - at[inner] - p[inner])
        start, end = at - backward, at + p + forward
        long = end - start >= np.maximum(LEAST, TIMES * p)
        found = np.unique(np.r_[found, np.c_[start, end, p][long]], axis=0)
        # A stretch of at least four periods whose smallest period is q has only multiples of q besides.
        found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)]] if len(found) else found
    return sorted((int(s), int(e - s), int(p)) for s, e, p in found)


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, exactly; ties to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def surplus(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        edge[s + p] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) > 0


def echoed(doc_id: object, ws: list[str]) -> list[str]:
    """``ws`` with a periodic end, for one doc_id in ten: the period and where it begins follow from the doc_id's CRC. A null doc_id has none."""
    h, n = (zlib.crc32(str(doc_id).encode()), len(ws)) if doc_id is not None else (1, 0)
    if h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + [ws[a + k % p] for k in range(n - a)]


def periodic_runs(docs: DataFrame, rewrite: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """Maximal runs of at least TIMES periods and LEAST words in every whole text.

    docs: doc_id, text; other columns are ignored, repeated rows stay, a null text has no words. Words are runs of characters other
    than the six ASCII white spaces. rewrite: changes (doc_id, words) before the search. Returns doc_id, n_words, runs
    (array of start, length, period; by start, then period), best (the run of greatest length / period, ties to the smallest start and
    period; null without runs), collapsed (the words that no run contains after its first period, joined by a space). Narrow: no
    shuffle; a worker holds one Arrow batch and the index of one text, which is linear in the text.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        named = lambda r: dict(zip(("start", "length", "period"), r))
        for batch in batches:
            counts, runs, best, kept = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws = words(text.as_py())
                if rewrite is not None:
                    ws = rewrite(doc_id, ws)
                numbers: dict[str, int] = {}
                found = find_runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int32, len(ws))) if len(ws) >= LEAST else []
                counts.append(len(ws))
                runs.append([named(r) for r in found])
                best.append(named(strongest(found)) if found else None)
                if found:
                    ws = [w for w, gone in zip(ws, surplus(len(ws), found).tolist()) if not gone]
                kept.append(" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(triple)), pa.array(best, triple), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_words long, runs array<{one}>, best {one}, collapsed string")
