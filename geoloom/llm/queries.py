"""The registered queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from geoloom.llm import licenses, pieces
from geoloom.llm.centroids import cluster_report, oracle_sql as centroid_sql
from geoloom.llm.jaccard import jaccard_join
from geoloom.llm.packing import pack_documents
from geoloom.llm.periods import echoed, periodic_runs
from geoloom.llm.pii import find_pii
from geoloom.llm.quality import quality
from geoloom.llm.sharding import shard
from geoloom.llm.substrings import dedup_bytes, dedup_words, digest
from geoloom.llm.vectors import near_vectors
from geoloom.llm.wordbpe import count_tokens


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_docs(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_docs(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", digest("kept").alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", digest("kept").alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return find_pii(_docs(spark, sf_dir)).select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_docs(spark, sf_dir))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, seed=2)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_docs(spark, sf_dir), echoed)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_sentencepiece, op3_best_fit_packing, op4_embedding_near_dedup, op5_suffix_array_dedup,
        op6_quality_rules, op7_token_counts, op8_substring_dedup, op9_pii, op10_ngram_jaccard,
        op11_centroid_clustering, op12_periodic_runs, op13_license_scan,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_centroid_clustering": centroid_sql(k=40, rounds=5, seed=2), "op13_license_scan": licenses.oracle_sql()}
