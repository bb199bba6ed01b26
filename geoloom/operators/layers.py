"""Points and clusters as GeoJSON: a feature to a row, or one collection for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.china import display_coordinate
from geoloom.functions.core import WGS84
from geoloom.functions.mercator import abbreviated


def feature(lon: Column, lat: Column, id_: Column, properties: Column) -> Column:
    """A point feature as JSON text; a null id is left out."""
    point = F.struct(F.array(lon, lat).alias("coordinates"), F.lit("Point").alias("type"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), id_.alias("id"), point.alias("geometry"), properties.alias("properties")))


def point_features(points: DataFrame, idx: str = "idx", display: str = WGS84) -> DataFrame:
    """(idx, feature) of WGS-84 points, drawn as WGS-84 or GCJ-02."""
    at = display_coordinate("lat", "lon", display)
    return points.withColumn("_at", at).select(
        F.col(idx).alias("idx"), feature(F.col("_at.lon"), F.col("_at.lat"), F.col(idx), F.struct(F.col(idx).alias("point_id"))).alias("feature")
    )


def cluster_features(clusters: DataFrame, display: str = WGS84) -> DataFrame:
    """(cluster_id, feature) of clusters (cluster_id, lat, lon, n, first_idx); a cluster of one point is that point."""
    many = F.col("n") > 1
    label = abbreviated(F.col("n"))
    properties = F.struct(
        F.when(many, True).alias("cluster"), F.when(many, F.col("cluster_id")).alias("cluster_id"), F.when(many, F.col("n")).alias("point_count"),
        F.when(many, label).alias("point_count_abbreviated"), F.when(~many, F.col("first_idx")).alias("point_id"),
    )
    made = feature(F.col("_at.lon"), F.col("_at.lat"), F.when(many, F.col("cluster_id")), properties)
    return clusters.withColumn("_at", display_coordinate("lat", "lon", display)).select("cluster_id", made.alias("feature"))


def collections(features: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A FeatureCollection for each group of features, in order: keys, geojson. A group becomes one text, so it should be of a tile's size."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "feature"))), lambda f: f["feature"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}"))
    return features.groupBy(*keys).agg(text.alias("geojson"))
