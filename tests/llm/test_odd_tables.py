"""The pipeline and the joins on tables with odd rows, none at all, and against brute force over a whole table."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm.jaccard import jaccard_join
from geoloom.llm.packing import pack_documents
from geoloom.llm.queries import vocabulary
from geoloom.llm.vectors import near_vectors

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, spans string, kept int"


def _odd(spark):
    rng = random.Random(6)
    prose = lambda n: ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(12)).capitalize() for _ in range(n)) + "."
    same, long = prose(6), prose(900)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, same), (5, same), (5, same), (None, prose(5)), (None, None), (6, long), (7, "x" * 3000), (8, prose(4) + " mail john@example.com now"), (9, prose(7))]
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "i", None, 1) for d, t in texts], SCHEMA)


def test_the_pipeline_takes_odd_rows(spark, tmp_path):
    docs = _odd(spark)
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        columns, before = docs.columns, docs.count()
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "best-fit packing":
            assert docs.columns == columns and docs.count() <= before
        if name == "quality rules":
            assert docs.where("text IS NULL OR text = ''").count() == 0 and docs.where("doc_id IN (4, 5)").count() == 3
        if name == "n-gram Jaccard join":
            assert docs.where("doc_id IN (4, 5)").select("doc_id").distinct().count() == 1
        if name == "PII":
            assert docs.where(F.col("text").contains("john@example.com")).count() == 0
    assert docs.count() > 0


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.schema(docs.schema).parquet(str(tmp_path / str(k))) if k < 4 else spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_the_jaccard_join_finds_all_links_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        if w:
            sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    at: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(d)
    links = dict.fromkeys((r.doc_id for r in docs.collect()), 0)
    for d, s in sets.items():
        common: dict[int, int] = {}
        for g in s:
            for o in at[g]:
                common[o] = common.get(o, 0) + 1
        links[d] = sum(1 for o, n in common.items() if o != d and n >= 0.8 * (len(s) + len(sets[o]) - n) - 1e-9)
    got = {r.doc_id: r.n_links for r in jaccard_join(docs).collect()}
    assert got == links and sum(links.values()) > 0


def test_packing_in_several_groups(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(1, 60)))) for k in range(400)], "doc_id long, text string")
    rows = pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_vectors_on_a_budget_edge(spark):
    # Pairs as far apart as may be, and just beyond, in the plane of two axes that blocks share out.
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.standard_normal((64, 64)))[0][:20]
    rows, want = [], {}
    for k, v in enumerate(base):
        other = np.linalg.qr(np.c_[v, rng.standard_normal(64)])[0][:, 1]
        for j, cos in enumerate((0.9500001, 0.9499999)):
            rows.append((10 * k + 1 + j, (cos * v + (1 - cos * cos) ** 0.5 * other).tolist()))
        rows.append((10 * k, v.tolist()))
        want |= {10 * k: 1, 10 * k + 1: 1, 10 * k + 2: 0}
    vec = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for i in vec:
        want[i] = sum(j != i and float(vec[i] @ vec[j]) >= 0.95 for j in vec)
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want and sum(want.values()) > 20


def test_blocks_of_vectors_meet_without_a_shuffle(spark, monkeypatch):
    """Vectors are shuffled to find equal ones, and never to meet others; huge ones have cosines as well."""
    import numpy as np

    from geoloom.llm import vectors

    plans, stage = [], vectors.stage
    monkeypatch.setattr(vectors, "stage", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, *a))
    g = np.random.default_rng(4)
    some = g.standard_normal((300, 8)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(some)] + [(1000 + k, v.tolist()) for k, v in enumerate(some[:50])]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tile=32).collect()}
    v = np.array([w for _, w in rows], float)
    size = np.linalg.norm(v, axis=1)
    near = v @ v.T >= 0.95 * size[:, None] * size[None, :]
    assert got == {k: int(n) - 1 for (k, _), n in zip(rows, near.sum(axis=1))}
    [meet] = [p for p in plans if "block" in p and "CartesianProduct" in p]
    assert "Exchange" not in meet and sum("Exchange" in p and "v#" in p for p in plans) <= 2
    huge = [(0, [1e200, 0.0, 0.0]), (1, [0.0, 1e200, 0.0]), (2, [1e200, 1e198, 0.0]), (3, [1e-200, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (0, 1), 2: (2, 0), 3: (2, 0)}
