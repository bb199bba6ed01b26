"""Boxes, centroids and grid buckets of groups of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.core import wrap_longitude
from geoloom.functions.geodesy import ELLIPSOIDS
from geoloom.functions.core import WGS84
from geoloom.functions.grids import geohash


#: Longitudes are looked at in bins of a tenth of a degree, so that neither a group nor a table without keys is one task's.
_BINS = 10


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` by ``keys``, in which null equals null; without keys ``b`` is one row, for all rows."""
    if not keys:
        return a.join(b, F.lit(True), how)
    other = b.select(*[F.col(k).alias(f"_{k}_") for k in keys], *[c for c in b.columns if c not in keys])
    on = a[keys[0]].eqNullSafe(other[f"_{keys[0]}_"])
    for k in keys[1:]:
        on = on & a[k].eqNullSafe(other[f"_{k}_"])
    return a.join(other, on, how).drop(*[f"_{k}_" for k in keys])


def bounds_agg(points: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Smallest box of each group: keys, south, west, north, east. Without keys the box of all points; null keys are a group.

    The widest gap between neighbouring longitudes is left out; of equal gaps the one over the antimeridian wins, then
    the lowest west edge. Poles have no longitude; a group of poles alone gets the meridian 0. Rows are reduced to
    distinct longitudes; gaps within a bin are looked at bin by bin, and those between bins from the bins' first and last
    longitudes, of which a group has 3,600.
    """
    lats = points.groupBy(*keys).agg(F.min(lat).alias("south"), F.max(lat).alias("north"))
    lons = (
        points.where(F.abs(lat) < 90.0).select(*keys, F.when(F.col(lon) == 180.0, F.lit(-180.0)).otherwise(F.col(lon)).alias("x")).where("x IS NOT NULL").distinct()
    )
    gap = lambda x, before: F.when(before.isNotNull(), F.struct((x - before).alias("gap"), (-x).alias("minus"), before.alias("east")))
    lons = lons.withColumn("bin", F.floor(F.col("x") * _BINS))
    bins = lons.withColumn("g", gap(F.col("x"), F.lag("x").over(W.partitionBy(*keys, "bin").orderBy("x")))).groupBy(*keys, "bin").agg(
        F.min("x").alias("first"), F.max("x").alias("last"), F.max("g").alias("inner")
    )
    between = gap(F.col("first"), F.lag("last").over(W.partitionBy(*keys).orderBy("bin")))
    gaps = bins.withColumn("inner", F.greatest("inner", between)).groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("inner").alias("inner"))
    wraps = F.coalesce(F.col("inner.gap"), F.lit(-1.0)) <= F.col("first") + 360.0 - F.col("last")
    west = F.when(wraps, F.col("first")).otherwise(-F.col("inner.minus"))
    east = F.when(wraps, F.col("last")).otherwise(F.col("inner.east"))
    arcs = gaps.select(*keys, west.alias("west"), F.when((east == -180.0) & (west != -180.0), F.lit(180.0)).otherwise(east).alias("east"))
    out = _met(lats, arcs, keys, "left")
    return out.select(*keys, "south", F.coalesce("west", F.lit(0.0)).alias("west"), "north", F.coalesce("east", F.lit(0.0)).alias("east"))


def surface_normal(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, l = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def centroid_agg(points: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon", crs: str = WGS84) -> DataFrame:
    """Normalised mean of each group's surface normals: keys, n, lat, lon, max_error_m.

    The bound is the largest angle from the centre times a*a/b, and a millionth of a metre. A group whose normals cancel
    has a null centre; null keys are a group, and without keys all points are one. Sums first (combined before the
    shuffle), then the largest angle against the joined centre.
    """
    e = ELLIPSOIDS[crs]
    x, y, z = surface_normal(F.col(lat), F.col(lon))
    sums = points.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(z).alias("sz"))
    size = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    middle = sums.select(*keys, "n", *[F.when(size > F.col("n") * 1e-9, F.col(f"s{k}") / size).alias(f"m{k}") for k in "xyz"])
    joined = _met(points.select(*keys, x.alias("x"), y.alias("y"), z.alias("z")), middle, keys)
    cx = F.col("y") * F.col("mz") - F.col("z") * F.col("my")
    cy = F.col("z") * F.col("mx") - F.col("x") * F.col("mz")
    cz = F.col("x") * F.col("my") - F.col("y") * F.col("mx")
    dot = F.col("x") * F.col("mx") + F.col("y") * F.col("my") + F.col("z") * F.col("mz")
    angle = F.atan2(F.sqrt(cx * cx + cy * cy + cz * cz), dot)
    return (
        joined.groupBy(*keys)
        .agg(F.first("n").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("mz").alias("mz"), F.max(angle).alias("spread"))
        .select(
            *keys, "n", F.degrees(F.atan2(F.col("mz"), F.hypot(F.col("mx"), F.col("my")))).alias("lat"),
            wrap_longitude(F.degrees(F.atan2(F.col("my"), F.col("mx")))).alias("lon"), (F.col("spread") * (e.a * e.a / e.b) + 1e-6).alias("max_error_m"),
        )
    )


def bucket_by_geohash(points: DataFrame, length: int, idx: str = "idx", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row per occupied cell: cell, n, first_idx and bucket_id, numbered from 0 by the earliest member.

    The numbers come from the cells alone, which are few against the points: ranges of first_idx are numbered each on
    its own and then moved by the cells in the ranges before.
    """
    cells = points.groupBy(geohash(lat, lon, length).alias("cell")).agg(F.count("*").alias("n"), F.min(idx).alias("first_idx"))
    return dense_number(cells, "first_idx", "bucket_id")


def dense_number(rows: DataFrame, order: str, name: str, width: int = 100_000) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... by a unique whole-number column, without sorting all rows in one task."""
    part = F.floor(F.col(order) / width)
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return rows.withColumn("_nth", nth).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


def summarize(points: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Each group's size, centroid with its bound, box and earliest member: keys, n, lat, lon, max_error_m, south, west, north, east, first_idx.

    points: keys, idx, lat, lon. Rows without a key (noise) are left out; without keys all rows are one group.
    """
    known = points
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    first = known.groupBy(*keys).agg(F.min(idx).alias("first_idx"))
    return _met(_met(centroid_agg(known, keys), bounds_agg(known, keys), keys), first, keys)


def cluster_record(members: Column, lat: Column, lon: Column, max_error_m: Column) -> Column:
    """STRUCT<members, lat, lon, max_error_m>; null unless the members are ascending, different and at least one."""
    rising = F.forall(F.sequence(F.lit(0), F.size(members) - 2), lambda i: F.get(members, i) < F.get(members, i + 1))
    ok = (F.size(members) == 1) | ((F.size(members) > 1) & rising)
    return F.when(ok, F.struct(members.alias("members"), lat.alias("lat"), lon.alias("lon"), max_error_m.alias("max_error_m")))
