"""The pipeline's stages against their operators' rules, one by one and together."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm.jaccard import jaccard_join
from geoloom.llm.packing import pack_documents
from geoloom.llm.pii import spans
from geoloom.llm.quality import quality
from geoloom.llm.queries import vocabulary
from geoloom.llm.substrings import dedup_bytes

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "PII", "best-fit packing"]
    before = docs
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "best-fit packing":
            assert after.columns == columns
        if name in ("quality rules", "n-gram Jaccard join"):
            verdicts = (quality if name == "quality rules" else jaccard_join)(before)
            kept = {r.doc_id for r in verdicts.where("kept").collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(kept)
        if name == "suffix-array dedup":
            want = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in dedup_bytes(before).collect()}
            assert {r.doc_id: r.text for r in after.collect()} == want
            assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "PII":
            assert not any(spans(r.text)[0] for r in after.collect())
        before = after if name != "best-fit packing" else before
    again = pack_documents(before, vocabulary("word_bpe_49k.json"))
    pick = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select(*pick).collect())) == sorted(map(tuple, again.select(*pick).collect()))
