"""Repeated windows: anchors that many texts share, hot anchors, very long texts, sorted suffixes."""

from __future__ import annotations

import random

import numpy as np

from geoloom.llm import repeats, substrings
from geoloom.llm.substrings import byte_starts, dedup_bytes, dedup_words, sorted_suffixes
from tests.llm.test_operators import masks


def _texts(n: int) -> list[str]:
    """A line in every text (shorter than a window), a passage in a third, and a pair of copies."""
    rng = random.Random(3)
    made = lambda k: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(k))
    line, passage, copy = made(8), made(60), made(50)
    out = [f"{made(rng.randrange(12, 40))} {line} {made(rng.randrange(12, 40))}{' ' + passage if k % 3 == 0 else ''}" for k in range(n)]
    return [*out, copy, copy, f"{made(30)} {copy}", f"{copy} {made(30)}"]


def _check(spark, texts: list[str], **part) -> None:
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    raw = [t.encode() for t in texts]
    want = {k: b[:0] + np.frombuffer(b, np.uint8)[~m].tobytes() for k, (b, m) in enumerate(zip(raw, masks(200, raw, bytes)))}
    assert {r.doc_id: bytes(r.kept) for r in dedup_bytes(frame, **part).collect()} == want
    cut = [t.split() for t in texts]
    want = {k: " ".join(x for x, g in zip(w, m) if not g) for k, (w, m) in enumerate(zip(cut, masks(35, cut, tuple)))}
    assert {r.doc_id: r.kept for r in dedup_words(frame, **part).collect()} == want


def test_an_anchor_with_many_segments(spark):
    _check(spark, _texts(400))


def test_hot_anchors_travel_by_window(spark):
    texts = _texts(120)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(repeats.plan(repeats.keyed(frame), substrings._BYTEWISE, hot=20).hot) > 1
    assert not repeats.plan(repeats.keyed(frame), substrings._BYTEWISE).hot
    _check(spark, texts, hot=20)


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(4)
    passage = " ".join(f"q{rng.randrange(10**5)}" for _ in range(200))
    long = " ".join(f"{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(90_000))
    k = long.index(" ", repeats.CHUNK - 500)
    long = f"{long[:k]} {passage}{long[k:]} {passage}"
    assert len(long) > 2 * repeats.CHUNK
    frame = spark.createDataFrame([(1, long), (2, passage), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup_bytes(frame).collect()}
    assert got[1][0] >= 2 * len(passage) and got[1][0] <= 2 * len(passage) + 4 and got[1][1] == 2
    assert got[2] == (len(passage), 1) and got[3] == (0, 0)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_words(frame).collect()}
    assert got == {1: (90_400, 400), 2: (200, 200), 3: (1, 0)}


def test_sorted_suffixes():
    rng = np.random.default_rng(5)
    raw = np.concatenate([rng.integers(97, 99, 400), np.zeros(48, int)]).astype(np.uint8)
    at = rng.permutation(400)[:300]
    order, common = sorted_suffixes(raw, at, 40)
    cut = [raw[a : a + 40].tobytes() for a in at[order]]
    assert cut == sorted(cut)
    for a, b, n in zip(cut, cut[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 40 or a[n] != b[n])


def test_empty_table(spark):
    assert byte_starts(repeats.keyed(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_equal_rows_have_their_spans_once(spark):
    text = _texts(1)[-3] * 2
    rows = spark.createDataFrame([(None, text)] * 600 + [(7, text), (8, "short")], "doc_id long, text string").repartition(8)
    held = repeats.keyed(rows)
    spans = repeats.with_spans(held, byte_starts(held)).select("doc_id", "spans").collect()
    assert max(len(r.spans or ()) for r in spans) <= 40
    assert {len(r.kept) for r in dedup_bytes(rows).collect()} == {0, 5}
