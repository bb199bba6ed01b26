"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and Python regex class body.
SPACE = r"\x20\x09-\x0D"

#: Shuffle files of a statement go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session has none, a single machine, as in tests, gets a temporary folder; a cluster gets an error, as its
    executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, at most ``per_file`` rows a file if that is given, and return the table read back.

    This cuts lineage so that a lost executor costs only its own tasks, and drops the shuffle files that fed the
    table. The tables are removed when the driver ends, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}", df.schema
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("maxRecordsPerFile", per_file).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stage`."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges(a long, b long)``, as (id, component).

    Alternates large-star and small-star steps, each one shuffle on the vertex with map-side minima; a round's edges
    are written to the shared folder, and only their count and checksum reach the driver. Vertices without an edge are
    not returned. Edges may repeat, point either way and contain loops; an empty table gives an empty table.
    """
    links = stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    for _ in range(most_rounds):
        both = links.union(links.select("b", "a")).toDF("u", "v")
        # The minima are read back from a table, so that the joins below can split a vertex that has many edges.
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stage(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        release(low)
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        small = stage(small)
        release(low)
        release(large)
        release(links)
        links = small
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
