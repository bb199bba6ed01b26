"""Centroid clustering, periodic runs and license scans against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import centroids, licenses, periods
from geoloom.llm.license_rules import RULES
from geoloom.llm.queries import op12_periodic_runs


# Centroid clustering


def lloyd(rows: list[tuple], k: int, rounds: int, seed: int, dims: int):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        owners = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, owners) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, *reversed(near(v))) for i, v in kept], at


def vectors(seed: int, n: int, dims: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.randrange(-3, 4) / 256 for _ in range(dims)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n, rows[0][1]), (None, rows[1][1]), (n + 1, None), (n + 2, []), (n + 3, [1.0] * (dims - 1)), (n + 4, [1.0] * (dims - 1) + [None]), (n + 5, [1.0] * (dims - 1) + [float("nan")]), (n + 6, [float("inf")] + [1.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize("k,rounds,dims", [(7, 5, 6), (40, 5, 4), (3, 0, 6), (200, 2, 5)])
def test_delta_lloyd_is_lloyd(spark, k, rounds, dims):
    rows = vectors(k, 150, dims)
    want, at = lloyd(rows, k, rounds, 2, dims)
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    got, found = centroids.clustered(table, k=k, rounds=rounds, dims=dims)
    assert found == at
    assert sorted((r.vec_id is not None, r.vec_id, r.cluster, r.distance) for r in got.collect() if r.vec_id is not None) == sorted((True, *w) for w in want if w[0] is not None)
    assert got.count() == len(want)
    report = centroids.cluster_report(table, k=k, rounds=rounds, dims=dims).collect()
    assert {r.inertia for r in report} == {sum(w[2] for w in want)}
    for r in report:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()


def test_clustering_of_nothing(spark):
    table = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster_report(table).collect() == []


def test_only_changed_centroids_are_compared():
    rng = np.random.default_rng(3)
    x, old = rng.integers(-40, 40, (3000, 8)), rng.integers(-40, 40, (9, 8))
    owner, distance = centroids.compared(x, np.full(3000, -1), np.zeros(3000, np.int64), old, np.arange(9))
    new = old.copy()
    new[[2, 5]] = rng.integers(-40, 40, (2, 8))
    got = centroids.compared(x, owner, distance, new, np.array([2, 5]))
    whole = centroids.compared(x, np.full(3000, -1), np.zeros(3000, np.int64), new, np.arange(9))
    assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()


# Periodic runs


def runs_of(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        start = 0
        while start + p < n:
            end = start + p
            while end < n and w[end] == w[end - p]:
                end += 1
            if end - start >= max(6, 4 * p):
                out.setdefault((start, end), p)
            start = max(start + 1, end - p + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_runs_of_short_texts_are_those_of_brute_force():
    rng = random.Random(1)
    for n in [*range(0, 40), 60, 100, 200]:
        for letters in (1, 2, 3):
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 20:
                at, p = rng.randrange(n // 2), rng.randrange(1, 6)
                for k in range(at + p, min(n, at + 7 * p)):
                    w[k] = w[k - p]
            assert periods.find_runs(np.array(w, np.int32)) == runs_of(w), w


def test_runs_of_long_texts_and_the_way_without_a_table(monkeypatch):
    rng = random.Random(4)
    w = [rng.randrange(50) for _ in range(1500)]
    w[100:160] = [1, 2, 3] * 20
    w[400:900] = (w[400:500]) * 5
    w[1000:1040] = [7] * 40
    want = runs_of(w)
    assert {p for _, _, p in want} >= {1, 3, 100}
    assert periods.find_runs(np.array(w, np.int32)) == want
    monkeypatch.setattr(periods, "TABLED", 64)
    monkeypatch.setattr(periods, "ASKED", 10)
    assert periods.find_runs(np.array(w, np.int32)) == want
    assert periods.find_runs(np.zeros(3000, np.int32)) == [(0, 3000, 1)]


def digest(lines: list[str] | str) -> str:
    return hashlib.sha256("".join(lines).encode()).hexdigest()


def test_the_query_is_its_definition(spark, tmp_path):
    rng = random.Random(9)
    words = ["a", "b", "c d", "e ", "f", "été", "g\x00h"]
    texts = [None, "", " \n\t ", "a", *["\t ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(120)], " ".join(["x", "y", "z"] * 30), "x " * 10 + "y z " * 9 + "q", "same " * 500, " ".join(f"w{k}" for k in range(9000))]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(5, texts[5], 1), (None, "a b a b a b a b a b", 1), (None, None, 2)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, n_words int").write.parquet(str(path))
    want = []
    for doc_id, text, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = runs_of(w)
        gone = {i for s, length, p in found for i in range(s + p, s + length)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
        milli = 1000 * best[1] // best[2] if found else None
        want.append((doc_id, len(found), *best, milli, digest([f"{s},{length},{p}\n" for s, length, p in found]), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[1] > 1 for w in want) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_runs_of_an_empty_table(spark):
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# License scans

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def scanned(text: str | None) -> tuple:
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, based = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        based |= {label} if at else set()
    plain, found = " " + ". ".join(w) + ".", []
    for r in RULES:
        for m in re.finditer(licenses.compiled(r.regex), plain):
            s = plain[: m.start()].count(" ")
            found.append((s, s + m.group().count(" "), r))
    kept = []
    for a in found:
        inside = [b for b in found if b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2].priority <= a[2].priority]
        if not any(b[:2] != a[:2] or (b[2].priority, b[2].number) < (a[2].priority, a[2].number) for b in inside):
            kept.append(a)
    labels = based | {a[2].label for a in kept}
    ranks = [a[2].priority for a in kept] + ([2] if based else [])
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(based)), ",".join(sorted(labels)), len(found), len(kept), {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.5}[min(ranks)] if ranks else 0.0


TEXTS = [
    None, "", "...\n", "MIT", "mit", "Released under the MIT License.", "under the MIT licence", "Licensed under the Apache License, Version 2.0 (the \"License\")", "CC BY-NC 4.0 and cc-by-nc-sa/4.0; CC BY NC",
    "SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later, GPLv3+, LGPL 2.1, the GNU General Public License", "# This work is licensed under the GNU General Public License, version 3\n" * 3,
    "under the mit license under the mit license", "emit license under the mit licenses", "émit license, mité license", "All rights reserved. Neither the name of Foo Bar Inc nor the names of its contributors may be used to endorse or promote products derived from this software",
    "http://www.apache.org/licenses/LICENSE-2.0 https://creativecommons.org/licenses/by-nc/4.0/ https://opensource.org/licenses/MIT", "cc by cc by nc cc by nc nd cc by", "the MIT License " * 200,
    "no license here, with a common server, universal font and fee", "İstanbul under THE mit LICENSE Kelvin",
]


def test_scans_are_those_of_brute_force(spark):
    rng = random.Random(7)
    pieces = [p for t in TEXTS if t for p in t.split()] + [k.replace("?", "") for k in ("license", "apache", "2", "0", "the", "cc", "by", "nc", "sa", "gpl", "version", "gnu", "mit")]
    texts = TEXTS + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(5, 80))) for _ in range(60)]
    rows = [(k % 50, t, "x") for k, t in enumerate(texts)] + [(None, "cc by nc", "y")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(d, *scanned(t)) for d, t, _ in rows], key=repr)


def test_every_rule_can_match_and_has_its_keyword(spark):
    def example(regex: str) -> str:
        while True:  # the shortest reading: optional groups out, first alternatives in
            new = re.sub(r"\(\?:([^()]*)\)(\?|\{0,\d+\})", "", regex)
            new = re.sub(r"\(\?:([^()|]*)(\|[^()]*)?\)(?![?{])", r"\1", new)
            if new == regex:
                break
            regex = new
        return re.sub(r"\[sc\]", "s", re.sub(r"\[01\]", "1", re.sub(r"\[\^\.\]\+", "some", re.sub(r"[^ \]]\?|[ ]\?", "", regex))))

    rows = [(r.number, example(r.regex)) for r in RULES]
    found = {(h.doc_id, h.number) for h in licenses.hits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(r.number, text) for r, (_, text) in zip(RULES, rows) if (r.number, r.number) not in found] == []
    assert len(RULES) > 200 and all(re.search(rf"(?<![a-z0-9]){r.keyword}(?![a-z0-9])", r.regex) for r in RULES)


def test_hits_are_kept_apart_by_their_places(spark):
    text = "see the GNU General Public License, version 3 or later"
    got = {(h.label, h.start, h.stop) for h in licenses.hits(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert {("gpl-3-or-later", 1, 10), ("gpl-3", 1, 8), ("gpl", 1, 6)} <= got
    assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == "gpl-3-or-later"


def test_a_long_text_of_licenses(spark):
    text = "Released under the MIT License. Apache License, Version 2.0; " * 3000
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (6000, 1, 30000 - 5, "apache-2,mit")


def test_scan_of_an_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
