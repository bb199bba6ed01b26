"""Counts of a stream of positions by grid cell and time window, and running a stream over what has arrived."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.grids import geohash
from geoloom.operators.tables import shared_root


def windowed_cells(fixes: DataFrame, length: int, width: str = "1 hour", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Streaming or batch fixes (ts, lat, lon) counted by window and geohash: start, end, cell, n, mean_lat, mean_lon.

    On a stream, a fix of a window that was given in an earlier batch is left out. A window is given once, when the
    watermark (``delay`` behind the newest fix) passes its end; state is one row for each open window and cell. Fixes
    without a time or position are left out.
    """
    seen = fixes.where(F.col(ts).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return (
        seen.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), geohash("lat", "lon", length).alias("cell"))
        .agg(F.count("*").alias("n"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cell", "n", "mean_lat", "mean_lon")
    )


def arrived(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over all that has arrived, into Parquet in the shared folder, and return that table."""
    spark = stream.sparkSession
    path = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
