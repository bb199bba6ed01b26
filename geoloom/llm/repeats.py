"""Windows of tokens that occur more than once in a corpus: what byte and word deduplication share.

A text is a row of tokens (bytes or words) and a window is ``width`` of them. Every window has an anchor: the run of
``gram`` tokens in it with the least hash, the left one of equals. Equal windows have equal anchors at equal places, so
the sampled positions, not all of them, need to be sorted or looked up. Consecutive windows with one anchor are a segment:
its tokens, and the anchor's place in them, are all that judging its windows takes. Segments of equal anchors meet in one
bucket, whatever their text, which costs one shuffle of about four times the text before compression.

A task packs what it sends to a bucket into compressed blobs, in which equal segments are stored once. An anchor that
occurs more than ``HOT`` times does not name a bucket: its windows travel one by one, under the whole window, so that such
groups spread too; equal windows have been combined by then.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import parts
from geoloom.llm.textwords import mix

BASE = 0x9E3779B97F4A7C15
#: Tokens of a text looked at together; bytes of text whose segments are packed together: bounds on a worker's memory.
CHUNK, PACKED = 1 << 18, 1 << 24
#: Segments with one anchor that a bucket takes, about 80 MB of them; bytes of segments that a bucket is planned for.
HOT, BUCKET = 1 << 18, 1 << 24
#: Anchors of the sample per bucket; how many times the text its segments take; bytes of text from anchor to anchor, about.
SAMPLED, SPREAD, APART = 64, 4, 75

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i under n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 14)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(a)
    p = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    p[:n] = a
    r = p.reshape(-1, w)
    ahead = np.minimum.accumulate(r, axis=1).ravel()
    behind = np.minimum.accumulate(r[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(tokens: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, anchor's place after start, anchor's hash) arrays of a text's segments.

    tokens: well-mixed 64-bit hashes. Very long texts are cut, which only makes some segments shorter.
    """
    for at in range(0, len(tokens) - width + 1, CHUNK):
        t = tokens[at : at + CHUNK + width - 1]
        n = len(t)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(t * up[:n], out=total[1:])
        g = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        low = np.uint64((1 << 22) - 1)
        order = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        anchor = (_least(order, width - gram + 1) & low).astype(np.int64)
        later = np.flatnonzero(anchor[1:] != anchor[:-1])
        edge = np.empty(len(later) + 2, np.int64)
        edge[0], edge[1:-1], edge[-1] = 0, later + 1, len(anchor)
        first = edge[:-1]
        place = anchor[first]
        yield first + at, np.diff(edge), place - first, g[place].view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, doc_id, text): rows told apart by doc_id and text; a null doc_id stands as the least number."""
    return docs.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("id"), F.xxhash64("text").alias("th"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )


@dataclass
class Kind:
    """What is compared. opened: a text's token hashes, its bytes, and where tokens begin and end in them (None: tokens are
    bytes); ranged: whether buckets are ranges of anchors' bytes, which takes tokens that are bytes."""

    width: int
    gram: int
    opened: Callable[[str], tuple[np.ndarray, bytes, np.ndarray | None, np.ndarray | None]]
    ranged: bool


@dataclass
class Plan:
    """Where segments go. leads: sorted splitters, the tokens that buckets begin with; hot: the upper 32 bits of the hashes of
    anchors that name no bucket."""

    buckets: int
    leads: list[bytes] = field(default_factory=list)
    hot: frozenset[int] = frozenset()


def plan(docs: DataFrame, kind: Kind, hot: int = HOT, bucket: int = BUCKET) -> Plan:
    """Buckets of about ``bucket`` bytes of segments, their splitters and the hot anchors, from a sample of anchors.

    The sample grows with the number of buckets, about SAMPLED anchors for each, and only it reaches the driver; so an anchor
    that fills a bucket or more of its own is all but sure to be in it many times. Its counts decide how segments travel,
    not which are found.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(parts(spark), -(-size * SPREAD // bucket))
    wanted = SAMPLED * buckets
    share = min(1.0, 4.0 * wanted * APART / max(size, 1))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, lead = [], []
            for text in batch.column(0).to_pylist():
                tokens, raw, _, _ = kind.opened(text)
                for start, _, off, hashes in segments(tokens, kind.width, kind.gram):
                    g += hashes.tolist()
                    lead += [raw[a : a + kind.gram] if kind.ranged else None for a in (start + off).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(lead, pa.binary())], ["g", "lead"])

    found = docs.select("text").sample(share, 7).mapInArrow(anchors, "g long, lead binary")
    thinned = min(1.0, wanted * APART / max(share * size, 1))
    some = found.where(F.rand(7) < thinned).collect()
    leads = sorted(bytes(r.lead) for r in some if kind.ranged)
    splitters = sorted({leads[len(leads) * k // buckets] for k in range(1, buckets)}) if leads else []
    each = 1 / (share * thinned)  # anchors that one of the sample stands for
    often: dict[int, int] = {}
    for r in some:
        often[r.g >> 32] = often.get(r.g >> 32, 0) + 1
    return Plan(buckets, splitters, frozenset(g for g, n in often.items() if n > 1 and n * each > hot))


_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*values) -> bytes:
    return _squeeze.compress(pickle.dumps(values, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(_expand.decompress(blob))


@dataclass
class Packed:
    """Different segments (times, count, off, g, size of its bytes, and the bytes joined) and the rows they occur in."""

    times: np.ndarray
    count: np.ndarray
    off: np.ndarray
    g: np.ndarray
    size: np.ndarray
    raw: bytes
    item: np.ndarray
    id: np.ndarray
    th: np.ndarray
    start: np.ndarray

    def contexts(self) -> list[bytes]:
        end = np.cumsum(self.size).tolist()
        return [self.raw[a:b] for a, b in zip([0, *end], end)]

    @classmethod
    def merged(cls, blobs: list[bytes]) -> Packed:
        """One of several blobs, each different segment once."""
        seen: dict[bytes, int] = {}
        times, facts, rows = [], [], []
        for blob in blobs:
            one = cls(*unpack(blob))
            place = np.fromiter((seen.setdefault(x, len(seen)) for x in one.contexts()), np.int64, len(one.size))
            times.append((place, one.times))
            facts.append((place, one.count, one.off, one.g))
            rows.append((place[one.item], one.id, one.th, one.start))
        place, many = (np.concatenate(x) for x in zip(*times))
        where = np.empty(len(seen), np.int64)
        where[place] = np.arange(len(place))
        count, off, g = (np.concatenate(x)[where] for x in list(zip(*facts))[1:])
        size = np.fromiter(map(len, seen), np.int64, len(seen))
        total = np.bincount(place, many, len(seen)).astype(np.int64)
        return cls(total, count, off, g, size, b"".join(seen), *(np.concatenate(x) for x in zip(*rows)))


def bundles(made: tuple, bucket: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob of a Packed) of the segments that :func:`gathered` made, with the occurrences flagged in ``which``."""
    contexts, times, count, off, g, item, ids, th, start = made
    item, ids, th, start = item[which], ids[which], th[which], start[which]
    by, rows = np.argsort(bucket, kind="stable"), np.argsort(bucket[item], kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0, True])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        some, k = by[a:b], bucket[by[a]]
        x, y = np.searchsorted(bucket[item][rows], [k, k + 1])
        r = rows[x:y]
        held = [contexts[i] for i in some.tolist()]
        size = np.fromiter(map(len, held), np.int64, len(held))
        yield int(k), pack(times[some], count[some], off[some], g[some], size, b"".join(held), place[item[r]] - a, ids[r], th[r], start[r])


def by_window(made: tuple, hot: frozenset[int]) -> list[int]:
    """The segments of hot anchors, each of one window."""
    return np.flatnonzero(np.isin(made[4], np.array(sorted(hot), np.int32))).tolist() if hot else []


def gathered(batches: Iterator[pa.RecordBatch], kind: Kind, hot: frozenset[int]) -> Iterator[tuple]:
    """The different segments of about PACKED bytes of them at a time.

    batches: id, th, text. Yields (contexts, times, count, off, g, item, id, th, start); the last four tell of each
    occurrence. The windows of hot anchors are segments of their own. Of an anchor's hash 32 bits are passed on.
    """
    seen: dict[bytes, int] = {}
    items: list[int] = []
    facts: list[tuple[np.ndarray, ...]] = []
    names: list[tuple[int, int, int]] = []
    held, hot_hashes = 0, np.array(sorted(hot), np.int32)

    def out() -> tuple:
        start, count, off, g = (np.concatenate(x) for x in zip(*facts))
        n, ids, th = (np.array(x, np.int64) for x in zip(*names))
        item = np.array(items, np.int64)
        first = np.unique(item, return_index=True)[1]
        made = list(seen), np.bincount(item), count[first], off[first], (g[first] >> 32).astype(np.int32), item, np.repeat(ids, n), np.repeat(th, n), start
        seen.clear(), items.clear(), facts.clear(), names.clear()
        return made

    for batch in batches:
        for id_, th, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            tokens, raw, begin, end = kind.opened(text)
            for start, count, off, g in segments(tokens, kind.width, kind.gram):
                if len(hot_hashes) and (one := np.isin((g >> 32).astype(np.int32), hot_hashes)).any():
                    times = np.where(one, count, 1)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    start, off, g, count = np.repeat(start, times) + step, np.repeat(off, times) - step, np.repeat(g, times), np.repeat(np.where(one, 1, count), times)
                for lo in range(0, len(start), 20_000):
                    part = tuple(x[lo : lo + 20_000] for x in (start, count, off, g))
                    a, b = part[0], part[0] + part[1] - 1 + kind.width
                    if begin is not None:
                        a, b = begin[a], end[b - 1]
                    before = len(seen)
                    items += [seen.setdefault(raw[x:y], len(seen)) for x, y in zip(a.tolist(), b.tolist())]
                    facts.append(part)
                    names.append((len(a), id_, th))
                    held += 40 * len(a) + int((b - a).sum()) * (len(seen) - before) // len(a)
                    if held >= PACKED:
                        yield out()
                        held = 0
    if items:
        yield out()


def with_spans(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """``docs`` of :func:`keyed` with ``spans``: the text's repeated starts as an array of (lo, hi), null if none.

    Rows of one id and text have the same spans, which are told once, however many such rows there are.
    """
    spans = starts.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return docs.join(spans, ["id", "th"], "left")


def removed(spans: Iterable[dict] | None, width: int) -> list[tuple[int, int]]:
    """Maximal runs of tokens that repeated windows cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] - 1 + width) for s in (() if spans is None else spans)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def runs(hit: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, lo, hi) of the runs of true flags in ``hit``, which holds ``count`` flags for each segment."""
    base = np.cumsum(count) - count
    first = np.zeros(len(hit) + 1, bool)
    first[base] = True
    first[-1] = True
    on = np.flatnonzero(hit & (first[:-1] | ~np.r_[False, hit[:-1]]))
    off = np.flatnonzero(hit & (first[1:] | ~np.r_[hit[1:], False])) + 1
    owner = np.searchsorted(base, on, "right") - 1
    return owner, on - base[owner], off - base[owner]
