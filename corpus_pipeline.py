"""The corpus pipeline: each stage works on the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import stage
from geoloom.llm.jaccard import jaccard_join
from geoloom.llm.packing import pack_documents
from geoloom.llm.pii import mask
from geoloom.llm.quality import quality
from geoloom.llm.queries import vocabulary
from geoloom.llm.substrings import strip_repeats


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is kept; rows that share a doc_id go only if none of them is kept."""
    kept = verdicts.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a verdict is one on a text, so rows that share a doc_id are judged apart."""
    verdicts = quality(docs.select(F.xxhash64("text").alias("doc_id"), "text"))
    kept = verdicts.where("kept").select(F.col("doc_id").alias("kept_text")).distinct()
    return docs.join(kept, F.xxhash64(docs["text"]) == kept["kept_text"], "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return _kept(docs, jaccard_join(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur more than once are removed from the texts; emptied documents stay, empty."""
    return _measured(strip_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return _measured(mask(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
