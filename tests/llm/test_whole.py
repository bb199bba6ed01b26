"""Cases in which the operators once did less than the whole job."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm.jaccard import jaccard_join
from geoloom.llm.pii import spans
from geoloom.llm.quality import KINDS, ON_GOOD, OTHER, OWN, SHARE, SMOOTH, fit, posterior, quality, votes

SF = "/root/testdata/sf0.01"


def test_near_copies_of_a_passage_that_many_longer_texts_hold(spark):
    rng = random.Random(11)
    made = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts: dict[int, list[str]] = {}
    for p in range(3):
        passage = made(60)
        texts[p], texts[10**6 + p] = passage + made(5), passage + made(5)
        for k in range(700):
            texts[1000 * (p + 1) + k] = made(25) + passage + made(27)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in texts.items()}
    at: dict[tuple, set[int]] = {}
    for d, s in sets.items():
        for g in s:
            at.setdefault(g, set()).add(d)
    want = {}
    for d, s in sets.items():
        others = set().union(*(at[g] for g in s)) - {d}
        want[d] = sum(10 * len(s & sets[o]) >= 8 * len(s | sets[o]) for o in others)
    assert sum(want.values()) == 6
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    for part in ({}, {"tile_sigs": 16}):
        assert {r.doc_id: r.n_links for r in jaccard_join(frame, **part).collect()} == want


@pytest.mark.parametrize("rest", ["", " Look at the dot on this."])
@pytest.mark.parametrize(
    ("before", "said"),
    [
        ("write to ", "john at example.com"),
        ("", "john\tat\texample\tdot\tcom"),
        ("card ", "4111 one one 1 1 1111 1111"),
        ("card ", "4-one-one-1 1111 1111 1111"),
        ("write to ", "john at example dot cloud"),
        ("write to ", "john at mail.example.pl"),
        ("write to ", "john[at]example.com"),
    ],
)
def test_disguises_need_nothing_else_in_the_text(before, said, rest):
    text = f"{before}{said} today.{rest}"
    base, found = spans(text)
    assert not base and [text[a:b] for a, b, _ in found] == [said]


@pytest.mark.parametrize("text", ["look at the dot on this", "we met at one two three places", "stay at home. Then go", "stare at the dot marked red"])
def test_plain_words_are_not_addresses(text):
    assert spans(text) == ([], [])


def _expected(patterns: dict[tuple[int, ...], int], names: list[str], rounds: int):
    """Expectation-maximisation in plain numpy."""
    votes_, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    kinds = [{f"vote_{k}" for k in kind} for kind in KINDS]
    share = np.array([SHARE] + [(1 - SHARE) / len(kinds)] * len(kinds))
    chance = np.array([[ON_GOOD] * len(names)] + [[OWN if k in kind else OTHER for k in names] for kind in kinds])

    def given():
        like = share * np.array([[np.prod([chance[c, k, v + 1] for k, v in enumerate(p)]) for c in range(len(share))] for p in votes_])
        return like / like.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        w = given() * n[:, None]
        share = (w.sum(axis=0) + 1) / (n.sum() + len(share))
        for k in range(len(names)):
            for v in (-1, 0, 1):
                chance[:, k, v + 1] = (w[votes_[:, k] == v].sum(axis=0) + SMOOTH) / (w.sum(axis=0) + 3 * SMOOTH)
    return share, chance, given()[:, 0]


def _patterns(spark, seen: dict[tuple[int, ...], int]):
    names = [f"vote_{k}" for k in votes()]
    return names, spark.createDataFrame([(*p, n) for p, n in seen.items()], ", ".join(f"{k} int" for k in names) + ", n long").coalesce(1)


def test_the_fit_equals_plain_em(spark):
    rng = random.Random(2)
    seen = {tuple(rng.choice((-1, 0, 1, 1)) for _ in votes()): rng.randrange(1, 300) for _ in range(40)}
    names, patterns = _patterns(spark, seen)
    share, chance, good = _expected(seen, names, 20)
    shares, chances = fit(patterns, names)
    assert np.allclose(shares, share) and np.allclose([[by[k] for k in names] for by in chances], chance)
    got = {tuple(r[k] for k in names): r.p for r in patterns.withColumn("p", F.get(posterior(shares, chances), F.lit(0))).collect()}
    assert np.allclose([got[p] for p in seen], good)


def test_the_posterior_decides_and_not_one_vote(spark):
    # Vote patterns as a corpus has them: symbols everywhere, repeats, plain prose, and prose with one wrong vote.
    plain, one = (1,) * 9, (1, 1, 1, 1, 1, -1, 1, 1, 1)
    marked, repeated = (-1, -1, 1, 1, 1, 1, -1, 1, 0), (1, 1, -1, -1, 1, -1, 1, 0, 1)
    names, patterns = _patterns(spark, {plain: 8000, one: 30, marked: 500, repeated: 400})
    p = patterns.withColumn("p", F.get(posterior(*fit(patterns, names)), F.lit(0))).collect()
    got = {tuple(r[k] for k in names): r.p >= 0.5 for r in p}
    assert got == {plain: True, one: True, marked: False, repeated: False}


def test_all_abstain_one_class_and_nothing(spark):
    nothing = (0,) * 9
    names, patterns = _patterns(spark, {nothing: 50})
    shares, chances = fit(patterns, names)
    assert abs(sum(shares) - 1) < 1e-9 and all(abs(sum(p) - 1) < 1e-9 for by in chances for p in by.values())
    names, patterns = _patterns(spark, {(1,) * 9: 50})
    assert patterns.withColumn("p", F.get(posterior(*fit(patterns, names)), F.lit(0))).first().p > 0.5
    shares, chances = fit(patterns.limit(0), names)
    assert shares[0] == SHARE and chances[0][names[0]] == ON_GOOD


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_labelled_documents(spark):
    kept = quality(spark.read.parquet(f"{SF}/documents.parquet")).where("NOT base_failed")
    got = kept.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[1, True] >= 50 * n.get((1, False), 0) and n.get((0, False), 0) >= 20 * n.get((0, True), 0)
    votes_ = [k for k in kept.columns if k.startswith("vote_")]
    junk = sum((F.col(k) == -1).cast("int") for k in votes_)
    assert kept.where("kept").where(junk == 1).count() > 0


def test_long_texts_are_not_less_varied(spark):
    rng = random.Random(5)
    words = [f"wort{k}" for k in range(400)]
    rows = [(1, " ".join(rng.choice(words) for _ in range(80))), (2, " ".join(rng.choice(words) for _ in range(6000))), (3, "eins zwei " * 40), (4, None)]
    got = {r.doc_id: r.vote_variety for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in (1, 2, 3)] == [1, 1, -1]
