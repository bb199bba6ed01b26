"""Exact substring deduplication over bytes (suffix sorting) and over words (repeated-phrase automata)."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import stage
from geoloom.llm.repeats import CHUNK, HOT, Kind, Packed, bundles, by_window, gathered, keyed, pack, plan, powers, removed, runs, unpack, with_spans
from geoloom.llm.textwords import mix, words

BYTES, BYTE_GRAM = 200, 24
WORDS, WORD_GRAM = 35, 8
#: Sub-shards that the occurrences of hot windows are dealt to.
SALTS = 16

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _by_bytes(text: str):
    raw = text.encode()
    return _BYTE[np.frombuffer(raw, np.uint8)], raw, None, None


def _by_words(text: str):
    raw = " ".join(words(text)).encode()
    if not raw:
        return np.zeros(0, np.uint64), raw, None, None
    flat = np.frombuffer(raw, np.uint8)
    blank = np.flatnonzero(flat == 32)
    start, end = np.empty(len(blank) + 1, np.int64), np.empty(len(blank) + 1, np.int64)
    start[0], start[1:], end[:-1], end[-1] = 0, blank + 1, blank, len(raw)
    # A word's hash sums its bytes' values, weighed by their places; some 256 KB of words at a time.
    edge = np.unique(np.searchsorted(start, np.arange(0, len(raw), CHUNK))).tolist() if len(raw) > CHUNK else [0]
    out = np.empty(len(start), np.uint64)
    for i, j in zip(edge, [*edge[1:], len(start)]):
        lo, hi = start[i], end[j - 1]
        up, down = powers(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[flat[lo:hi]] * up[:-1], out=total[1:])
        out[i:j] = mix((total[end[i:j] - lo] - total[start[i:j] - lo]) * down[start[i:j] - lo])
    return out, raw, start, end


_BYTEWISE = Kind(BYTES, BYTE_GRAM, _by_bytes, True)
_WORDWISE = Kind(WORDS, WORD_GRAM, _by_words, False)
_STARTS = "id long, th long, lo long, hi long"


def sorted_suffixes(raw: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes of ``raw`` that start at ``at``, by their first ``depth`` bytes, eight a step.

    A step splits every class of suffixes that agree so far by their next eight bytes; one alone in its class is done
    with. Returns the order and each suffix's common prefix, at most ``depth``, with the one before it in that order.
    depth: a multiple of eight, by which raw goes on after the last start.
    """
    eight = np.lib.stride_tricks.as_strided(raw, (max(len(raw) - 7, 0), 8), (1, 1))
    order, common = np.arange(len(at)), np.zeros(len(at), np.int16)
    live, kind = np.arange(len(at)), np.zeros(len(at), np.int64)
    for d in range(0, depth, 8):
        if not len(live):
            break
        some = order[live]
        key = np.ascontiguousarray(eight[at[some] + d]).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((key, kind))
        key = key[by]
        order[live] = some[by]
        apart, same = key[1:] ^ key[:-1], kind[1:] == kind[:-1]
        cut = same & (apart != 0)
        x = apart[cut]
        equal = sum((x < np.uint64(1 << k)).astype(np.int16) for k in range(8, 64, 8))
        common[live[1:][cut]] = d + equal
        number = np.cumsum(np.r_[True, ~same | cut]) - 1
        many = np.bincount(number)[number] > 1
        live, kind = live[many], number[many]
    common[live[1:][kind[1:] == kind[:-1]]] = depth
    return order, common


def repeated_windows(found: Packed, width: int = BYTES, gram: int = BYTE_GRAM) -> np.ndarray:
    """Whether each window of each segment is also in another segment, one flag after the other.

    The suffixes at the anchors are sorted forwards, and the prefixes before them backwards. A window with o bytes before its
    anchor is a pair: the class of suffixes that agree on width - o bytes, and that of prefixes that agree on o; both are
    stretches of the sorted orders. Windows with equal pairs are equal.
    """
    pad = bytes(width + 16)
    raw = np.frombuffer(pad + found.raw + pad, np.uint8)
    anchor = np.cumsum(found.size) - found.size + len(pad) + found.off
    depth = -(-width // 8) * 8
    order, common = sorted_suffixes(raw, anchor, depth)
    near = common >= gram
    shared = near | np.r_[near[1:], False]
    order, common = order[shared], common[shared]
    base = np.cumsum(found.count) - found.count
    hit = np.repeat(found.times > 1, found.count)
    if not len(order):
        return hit
    some = np.sort(order)
    order = np.searchsorted(some, order)
    back, shared_back = sorted_suffixes(np.ascontiguousarray(raw[::-1]), len(raw) - anchor[some], depth)
    off, first, base = found.off[some], found.off[some] - found.count[some] + 1, base[some]
    left, right = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
    for o in range(int(first.min()), int(off.max()) + 1):
        has = np.flatnonzero((first <= o) & (o <= off))
        if len(has) < 2:
            continue
        right[order] = np.cumsum(common < width - o)
        left[back] = np.cumsum(shared_back < o)
        pair = left[has] * (len(some) + 1) + right[has]
        by = np.argsort(pair)
        equal = pair[by][1:] == pair[by][:-1]
        twice = has[by[np.r_[equal, False] | np.r_[False, equal]]]
        hit[base[twice] + off[twice] - o] = True
    return hit


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(bucket, its rows as (kind, blob)) of batches sorted by bucket; each bucket's rows are to be read before the next."""
    from itertools import groupby

    rows = ((b, k, x.as_py()) for batch in batches for b, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
    for bucket, some in groupby(rows, lambda r: r[0]):
        yield bucket, ((k, x) for _, k, x in some)


_DEALT = "bucket int, kind int, blob binary"


def _dealt(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])


def _starts(ids, th, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, th, lo, hi)], ["id", "th", "lo", "hi"])


def _located(found: Packed, hit: np.ndarray) -> pa.RecordBatch:
    """The runs of repeated windows in the rows that the segments occur in."""
    owner, lo, hi = runs(hit, found.count)
    a, b = np.searchsorted(owner, found.item), np.searchsorted(owner, found.item, "right")
    row = np.repeat(np.arange(len(a)), b - a)
    run = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]
    return _starts(found.id[row], found.th[row], found.start[row] + lo[run], found.start[row] + hi[run])


def byte_starts(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Runs of starts of repeated byte windows, as (id, th, lo, hi), hi exclusive; runs of a text may touch or repeat.

    docs: from :func:`keyed`. Segments are range-partitioned by their anchors' bytes with sampled splitters, and each
    bucket sorts its suffixes. Segments that a task meets twice are repeated; one of them goes on, for others to meet.
    """
    kind, to = _BYTEWISE, plan(docs, _BYTEWISE, hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = np.array(to.leads or [b""], f"S{kind.gram}")
        for made in gathered(batches, kind, to.hot):
            contexts, times, count, off, _, item, ids, th, start = made
            lead = [c[o : o + kind.gram] for c, o in zip(contexts, off.tolist())]
            bucket = np.searchsorted(splitters, np.array(lead, f"S{kind.gram}"), "right")
            for k in by_window(made, to.hot):
                bucket[k] = zlib.crc32(contexts[k]) % to.buckets
            again = times[item] > 1
            made = (*made[:4], np.zeros(len(contexts), np.int32), *made[5:])  # anchors are told by their bytes
            out = [(b, 0, x) for b, x in bundles(made, bucket, ~again)]
            if again.any():
                out.append((out[0][0], 1, pack(ids[again], th[again], start[again], start[again] + count[item[again]])))
            yield _dealt(out)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            held = []
            for k, blob in rows:
                if k:
                    yield _starts(*unpack(blob))
                else:
                    held.append(blob)
            if held:
                found = Packed.merged(held)
                yield _located(found, repeated_windows(found))

    dealt = docs.select("id", "th", "text").mapInArrow(deal, _DEALT)
    return stage(dealt.repartition(to.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, _STARTS))


def _coded(segments: list[bytes], code: dict[str, str], grow: bool) -> list[str]:
    """Segments with one character for each word; words without a code share one."""
    out = []
    for c in segments:
        ws = c.decode().split(" ")
        if grow:
            for w in ws:
                if w not in code:
                    k = 256 + len(code)
                    code[w] = chr(k if k < 0xD800 else k + 0x800)
        out.append("".join([code.get(w, "\1") for w in ws]))
    return out


def confirmed(found: Packed, width: int = WORDS) -> tuple[list[str], set[int]]:
    """The recurring passages, and their anchors: the different runs of words all of whose windows occur more than once.

    A run is one of some segment and ends where a window occurs once, so each segment's recurring windows are passages. Equal
    windows have equal anchors, so segments are looked at by anchor; one that stands alone is a passage if it occurs twice.
    """
    by = np.argsort(found.g, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(found.g[by]) != 0, True]).tolist()
    contexts, out, anchors = found.contexts(), {}, set()
    for lo, hi in zip(edge, edge[1:]):
        some = by[lo:hi].tolist()
        if len(some) == 1:
            if found.times[some[0]] > 1:
                out[contexts[some[0]].decode()] = None
                anchors.add(int(found.g[some[0]]))
            continue
        code: dict[str, str] = {}
        facts = list(zip(_coded([contexts[i] for i in some], code, True), found.count[some].tolist(), found.times[some].tolist()))
        seen: Counter[str] = Counter()
        for s, n, t in facts:
            for k in range(n):
                seen[s[k : k + width]] += t
        word: dict[str, str] = {}
        for i, (s, n, t) in zip(some, facts):
            hit = [True] * n if t > 1 else [seen[s[k : k + width]] > 1 for k in range(n)]
            if all(hit):
                out[contexts[i].decode()] = None
            elif any(hit):
                word = word or {x: w for w, x in code.items()}
                runs_ = np.flatnonzero(np.diff(np.r_[0, np.array(hit, np.int8), 0])).tolist()
                for a, b in zip(runs_[::2], runs_[1::2]):
                    out[" ".join([word[x] for x in s[a : b - 1 + width]])] = None
            else:
                continue
            anchors.add(int(found.g[i]))
    return list(out), anchors


class Automaton:
    """Finds passages, and so the windows in them, in segments: Aho-Corasick over words."""

    def __init__(self, passages: list[str], anchors: set[int], width: int = WORDS):
        self.code: dict[str, str] = {}
        #: What was found in the shard's different segments, which are as many as a bucket is planned for.
        self.known: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self.machine, self.width, self.anchors = ahocorasick.Automaton(), width, np.array(sorted(anchors), np.int32)
        for s in _coded([p.encode() for p in passages], self.code, True):
            self.machine.add_word(s, len(s))
        if len(self.machine):
            self.machine.make_automaton()

    def locate(self, found: Packed) -> np.ndarray:
        """Whether each window of each segment is in a passage, one flag after the other; other anchors have no passage."""
        hit, base = np.zeros(int(found.count.sum()), bool), np.cumsum(found.count) - found.count
        some = []
        if len(self.machine):
            near = self.anchors[np.minimum(np.searchsorted(self.anchors, found.g), len(self.anchors) - 1)]
            some = np.flatnonzero(near == found.g).tolist()
        contexts = found.contexts() if some else []
        for i in some:
            if (runs_ := self.known.get(contexts[i])) is None:
                runs_ = self.known[contexts[i]] = self._search(contexts[i])
            for a, b in runs_:
                hit[base[i] + a : base[i] + b] = True
        return hit

    def _search(self, context: bytes) -> tuple[tuple[int, int], ...]:
        """Runs of the windows that passages cover."""
        out: list[tuple[int, int]] = []
        (s,) = _coded([context], self.code, False)
        for end, n in self.machine.iter(s):
            stop = end + 2 - self.width
            start = stop - (n - self.width + 1)
            while out and out[-1][1] >= start:
                last = out.pop()
                start = min(start, last[0])
            out.append((start, stop))
        return tuple(out)


def word_starts(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Runs of starts of repeated word windows, as (id, th, lo, hi), hi exclusive; runs of a text may touch or repeat.

    docs: from :func:`keyed`. Anchors name shards. First the different segments of each task go to their shards, without
    telling whose they are, and confirm the recurring passages; then each shard's passages are compiled into an automaton, and all
    documents' segments stream through the automata of their shards, which locate the occurrences. Hot windows' occurrences stream through
    SALTS copies of their automata.
    """
    kind, to = _WORDWISE, plan(docs, _WORDWISE, hot)
    shards = to.buckets

    def route(made: tuple) -> np.ndarray:
        """Shards; those of hot windows, which the whole window names, come after the others."""
        shard = made[4].view(np.uint32).astype(np.int64) % shards
        for k in by_window(made, to.hot):
            shard[k] = shards + zlib.crc32(made[0][k]) % shards * SALTS
        return shard

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in gathered(batches, kind, to.hot):
            yield _dealt([(b, 0, x) for b, x in bundles(made, route(made), np.zeros(len(made[5]), bool))])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _grouped(batches):
            passages, anchors = confirmed(Packed.merged([blob for _, blob in rows]))
            if passages:
                blob = pack(passages, anchors)
                yield _dealt([(shard + k, 0, blob) for k in range(SALTS if shard >= shards else 1)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for made in gathered(batches, kind, to.hot):
            shard = route(made)
            shard = np.where(shard < shards, shard, shard + turn % SALTS)
            turn += 1
            yield _dealt([(b, 1, x) for b, x in bundles(made, shard, np.ones(len(made[5]), bool))])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            machine = None
            for k, blob in rows:  # passages come first
                if k == 0:
                    machine = Automaton(*unpack(blob))
                elif machine:
                    found = Packed(*unpack(blob))
                    yield _located(found, machine.locate(found))

    texts = docs.select("id", "th", "text")
    at_shards = lambda df: df.repartition(to.buckets, "bucket").sortWithinPartitions("bucket", "kind")
    passages = stage(at_shards(texts.mapInArrow(offer, _DEALT)).mapInArrow(confirm, _DEALT))
    return stage(at_shards(texts.mapInArrow(stream, _DEALT).unionByName(passages)).mapInArrow(locate, _STARTS))


def dedup_bytes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a BYTES-byte string that starts anywhere else in the corpus.

    docs: doc_id, text; other columns are ignored; a null text is empty; shorter texts lose nothing; of two equal rows
    both lose all that repeats. Strings are judged on the input. Returns one row per row: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), spans (array of (lo, hi) in bytes) and kept (the bytes left).
    """
    rows = keyed(docs)
    starts = byte_starts(rows, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for t, s in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, gaps = t.as_py().encode(), removed(s, BYTES)
                edges = [0, *[x for r in gaps for x in r], len(raw)]
                n.append(len(raw))
                gone.append(sum(b - a for a, b in gaps))
                spans.append([{"lo": a, "hi": b} for a, b in gaps])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            of = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, of), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return with_spans(rows, starts).select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary"
    )


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes of ``text`` removed, as :func:`dedup_bytes` finds them; rows and other columns
    stay. A character of which only some bytes are repeated goes whole. A null text stays null."""
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    rows = docs.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("id"), F.xxhash64("text").alias("th"), "doc_id", "text", others.alias("others")
    )
    starts = byte_starts(keyed(docs))

    @F.pandas_udf("string")
    def left(text, spans):
        out = []
        for t, s in zip(text, spans):
            if t is not None and s is not None:
                raw = t.encode()
                edges = [0, *[x for r in removed(s, BYTES) for x in r], len(raw)]
                t = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")
            out.append(t)
        return text.__class__(out, dtype=object)

    out = with_spans(rows, starts).withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(left("text", "spans")))
    return out.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])


def dedup_words(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Remove each word covered by a run of WORDS words that starts anywhere else in the corpus.

    docs: doc_id, text; other columns are ignored; a null text has no words; shorter texts lose nothing. Windows are
    judged on the input. Returns one row per row: doc_id, n_words, n_removed, kept (words left, joined by spaces).
    """
    rows = keyed(docs)
    starts = word_starts(rows, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for t, s in zip(batch.column(1), batch.column(2).to_pylist()):
                ws, gaps = words(t.as_py()), removed(s, WORDS)
                edges = [0, *[x for r in gaps for x in r], len(ws)]
                n.append(len(ws))
                gone.append(sum(b - a for a, b in gaps))
                kept.append(" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in ws[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(rows, starts).select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: str):
    """Lowercase hex SHA-256 of a string or binary column, as UTF-8."""
    return F.sha2(F.col(kept).cast("binary"), 256)


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
