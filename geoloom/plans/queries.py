"""Registered geospatial queries: name to (spark, sf_dir) -> DataFrame, and independent DuckDB SQL.

The driver's tables hold no coordinates, so positions are derived from keys: spread over the globe (``spread``), or near
one of a few towns for each user (``town``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import china, core, geodesy, grids, mercator, text
from geoloom.operators.aggregates import bounds_agg, bucket_by_geohash, centroid_agg
from geoloom.operators.dbscan import dbscan
from geoloom.operators.joins import knn_join, radius_join, reverse_lookup
from geoloom.operators.tracks import asof_locate, locate_fixes, segment_trips, segment_visits, visit_members, visit_summaries, zones_strip
from geoloom.sources.freetext import parse_text
from geoloom.sources.sentences import parse_geo_uri, parse_nmea
from geoloom.streaming.cells import arrived, windowed_cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _d(x: Column, scale: int, shift: int) -> Column:
    return x.cast("double") / F.lit(float(scale)) - F.lit(float(shift))


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with (lat, lon) over the globe: latitudes within 80 degrees, longitudes in [-180, 180]."""
    e, u = F.col("event_id"), F.col("user_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "ts", "event_type",
        _d((e * 7919 + u * 104729) % 1600001, 10000, 80).alias("lat"), _d((e * 15485863 + u * 32452843) % 3600001, 10000, 180).alias("lon"),
    )


def town(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with (lat, lon) within about 200 m of a town of their user's."""
    e, u = F.col("event_id"), F.col("user_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "ts", "event_type",
        (_d((u * 104729) % 121, 1, 60) + _d((e * 7919) % 2001, 1000000, 0)).alias("lat"),
        (_d((u * 32452843) % 351, 1, 175) + _d((e * 15485863) % 2003, 1000000, 0)).alias("lon"),
    )


SPREAD = """spread AS (SELECT event_id, user_id, ts, event_type,
  CAST((event_id*7919 + user_id*104729) % 1600001 AS DOUBLE)/CAST(10000 AS DOUBLE) - CAST(80 AS DOUBLE) AS lat,
  CAST((event_id*15485863 + user_id*32452843) % 3600001 AS DOUBLE)/CAST(10000 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon FROM events)"""
TOWN = """town AS (SELECT event_id, user_id, ts, event_type,
  (CAST((user_id*104729) % 121 AS DOUBLE) - CAST(60 AS DOUBLE)) + CAST((event_id*7919) % 2001 AS DOUBLE)/CAST(1000000 AS DOUBLE) AS lat,
  (CAST((user_id*32452843) % 351 AS DOUBLE) - CAST(175 AS DOUBLE)) + CAST((event_id*15485863) % 2003 AS DOUBLE)/CAST(1000000 AS DOUBLE) AS lon FROM events)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    """Haversine metres in SQL, by the arc sine."""
    h = f"(power(sin((radians({c})-radians({a}))/2),2) + cos(radians({a}))*cos(radians({c}))*power(sin(radians({d}-({b}))/2),2))"
    return f"(2*6371008.8*asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {h})))))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(x: Column, digits: int) -> Column:
    return F.round(x, digits) + 0.0


@query(f"""WITH {SPREAD}, d AS (SELECT *, {_hav('lat','lon','47.3769::DOUBLE','8.5417::DOUBLE')} AS m FROM spread)
SELECT event_id, user_id, round(m, 3) AS distance_m FROM d WHERE m <= 2000000""")
def haversine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("m", geodesy.haversine("lat", "lon", 47.3769, 8.5417))
    return p.where("m <= 2000000").select("event_id", "user_id", _r(F.col("m"), 3).alias("distance_m"))


_GEOHASH_SQL = "'0123456789bcdefghjkmnpqrstuvwxyz'"


def _geohash_sql(length: int) -> str:
    n_lon, n_lat = (5 * length + 1) // 2, 5 * length // 2
    out = []
    for k in range(length):
        bits = []
        for b in range(5):
            at = 5 * k + b
            v, s = ("gx", n_lon - 1 - at // 2) if at % 2 == 0 else ("gy", n_lat - 1 - at // 2)
            bits.append(f"(({v} >> {s}) & 1) * {1 << (4 - b)}")
        out.append(f"substr({_GEOHASH_SQL}, CAST({' + '.join(bits)} + 1 AS INT), 1)")
    grid = (
        f"g AS (SELECT *, CAST(least(floor((lon+180)/360*{1 << n_lon}), {(1 << n_lon) - 1}) AS BIGINT) AS gx, "
        f"CAST(least(floor((lat+90)/180*{1 << n_lat}), {(1 << n_lat) - 1}) AS BIGINT) AS gy FROM spread)"
    )
    return f"{grid}, h AS (SELECT *, {' || '.join(out)} AS cell FROM g)"


@query(f"""WITH {SPREAD}, {_geohash_sql(5)}, c AS (SELECT cell, count(*) AS n, min(event_id) AS first_idx FROM h GROUP BY cell)
SELECT cell, n, first_idx, row_number() OVER (ORDER BY first_idx) - 1 AS bucket_id FROM c""")
def geohash_bucket_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_by_geohash(spread(spark, sf_dir).withColumnRenamed("event_id", "idx"), 5)


@query(f"""WITH {SPREAD} SELECT event_id,
 (lat BETWEEN -20 AND 45 AND (lon >= 150 OR lon <= -120)) AS pacific, (lat BETWEEN 35 AND 60 AND lon BETWEEN -10 AND 30) AS europe FROM spread""")
def box_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pacific, europe = geodesy.box(-20, 150, 45, -120), geodesy.box(35, -10, 60, 30)
    return spread(spark, sf_dir).select(
        "event_id", geodesy.box_contains(pacific, "lat", "lon").alias("pacific"), geodesy.box_contains(europe, "lat", "lon").alias("europe")
    )


@query(f"""WITH {SPREAD}, b AS (SELECT event_id, lat AS s, least(lat+10, 90) AS n, lon AS w, CASE WHEN lon+15 > 180 THEN lon+15-360 ELSE lon+15 END AS e FROM spread)
SELECT event_id, NOT (s > 45 OR n < -20) AND (
   (CASE WHEN w <= e THEN 150 BETWEEN w AND e ELSE 150 >= w OR 150 <= e END) OR (w >= 150 OR w <= -120)) AS hit FROM b""")
def box_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    east = F.when(F.col("lon") + 15 > 180, F.col("lon") + 15 - 360).otherwise(F.col("lon") + 15)
    own = geodesy.box("lat", "lon", F.least(F.col("lat") + 10, F.lit(90.0)), east)
    return spread(spark, sf_dir).select("event_id", geodesy.box_intersects(geodesy.box(-20, 150, 45, -120), own).alias("hit"))


@query(f"""WITH {SPREAD}, u AS (SELECT * FROM spread), l AS (SELECT DISTINCT user_id, CASE WHEN lon = 180 THEN -180 ELSE lon END AS x FROM u),
o AS (SELECT user_id, x, lag(x) OVER (PARTITION BY user_id ORDER BY x) AS p, min(x) OVER (PARTITION BY user_id) AS lo, max(x) OVER (PARTITION BY user_id) AS hi FROM l),
g AS (SELECT user_id, x AS west, coalesce(p, hi) AS east, CASE WHEN p IS NULL THEN lo + 360 - hi ELSE x - p END AS gap, CASE WHEN p IS NULL THEN 0 ELSE 1 END AS later FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, later, west) AS rn FROM g),
s AS (SELECT user_id, min(lat) AS south, max(lat) AS north FROM u GROUP BY user_id)
SELECT s.user_id, round(south,7) AS south, round(west,7) AS west, round(north,7) AS north, round(east,7) AS east FROM s JOIN k USING (user_id) WHERE rn = 1""")
def bounds_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir)
    return bounds_agg(p, ["user_id"]).select("user_id", *[_r(F.col(k), 7).alias(k) for k in ("south", "west", "north", "east")])


@query(f"""WITH {TOWN}, v AS (SELECT user_id, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM town),
m AS (SELECT user_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM v GROUP BY user_id)
SELECT user_id, n, round(degrees(atan2(sz, sqrt(sx*sx+sy*sy))), 7) AS lat, round(degrees(atan2(sy, sx)), 7) AS lon FROM m""")
def centroid_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_agg(town(spark, sf_dir), ["user_id"]).select("user_id", "n", _r(F.col("lat"), 7).alias("lat"), _r(F.col("lon"), 7).alias("lon"))


@query(f"""WITH {SPREAD}, x AS (SELECT event_id, lat*3 AS a, lon*5 AS b FROM spread)
SELECT event_id, round(b - 360*floor((b+180)/360), 6) + 0.0::DOUBLE AS wrapped, round(greatest(least(a, 90), -90), 6) AS clamped, round(b - 360*floor(b/360), 6) AS turned FROM x""")
def wrap_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).select("event_id", (F.col("lat") * 3).alias("a"), (F.col("lon") * 5).alias("b"))
    return p.select(
        "event_id", _r(core.wrap_longitude("b"), 6).alias("wrapped"), _r(core.clamp_latitude("a"), 6).alias("clamped"), _r(core.normalize_degrees("b"), 6).alias("turned")
    )


@query(f"""WITH {SPREAD}, a AS (SELECT event_id, lat, abs(lat) AS m FROM spread), b AS (SELECT *, floor(m) AS d, (m - floor(m))*60 AS mi FROM a)
SELECT event_id, CAST(d AS INT) AS deg, CAST(floor(mi) AS INT) AS min, round((mi - floor(mi))*60, 5) AS sec, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END AS hemi, round(mi, 6) AS ddm_min, round(lat, 9) AS back FROM b""")
def dms_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("x", core.dms_from_degrees("lat", "lat"))
    x = F.col("x")
    return p.select(
        "event_id", "x.deg", "x.min", _r(x["sec"], 5).alias("sec"), "x.hemi", _r(core.dms_to_ddm(x)["min"], 6).alias("ddm_min"), _r(core.dms_to_degrees(x), 9).alias("back")
    )


@query("""SELECT event_id, round(value*1609.344/1852, 6) AS nmi, round(value*1609.344/(1200.0::DOUBLE/3937.0::DOUBLE), 4) AS us_ft, round(value*1609.344/0.9144, 5) AS yd FROM events""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = core.from_unit("value", "mi")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", _r(core.to_unit(m, "nmi"), 6).alias("nmi"), _r(core.to_unit(m, "us_ft"), 4).alias("us_ft"), _r(core.to_unit(m, "yd"), 5).alias("yd")
    )


# Positions inside the China box, from the same keys.
CHINA = """china AS (SELECT event_id, 2 + CAST((event_id*7919) % 500003 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat, 73 + CAST((event_id*15485863) % 640007 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon FROM events)"""


def in_china(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _d((e * 7919) % 500003, 10000, -2).alias("lat"), _d((e * 15485863) % 640007, 10000, -73).alias("lon"))


def _gcj_sql(lat: str, lon: str, out: str, source: str) -> str:
    """CTEs that add GCJ-02 offsets (dlat, dlon) at a position, written out from the published formula."""
    return f"""{out}0 AS (SELECT *, {lon} - 105 AS px, {lat} - 35 AS py, sin(radians({lat})) AS ps FROM {source}),
{out} AS (SELECT *, (-100 + 2*px + 3*py + 0.2*py*py + 0.1*px*py + 0.2*sqrt(abs(px)) + (20*sin(6*px*pi()) + 20*sin(2*px*pi()))*2/3 + (20*sin(py*pi()) + 40*sin(py/3*pi()))*2/3 + (160*sin(py/12*pi()) + 320*sin(py*pi()/30))*2/3)
  * 180 / (6378245.0*(1-0.00669342162296594)/((1-0.00669342162296594*ps*ps)*sqrt(1-0.00669342162296594*ps*ps))*pi()) AS dlat,
 (300 + px + 2*py + 0.1*px*px + 0.1*px*py + 0.1*sqrt(abs(px)) + (20*sin(6*px*pi()) + 20*sin(2*px*pi()))*2/3 + (20*sin(px*pi()) + 40*sin(px/3*pi()))*2/3 + (150*sin(px/12*pi()) + 300*sin(px/30*pi()))*2/3)
  * 180 / (6378245.0/sqrt(1-0.00669342162296594*ps*ps)*cos(radians({lat}))*pi()) AS dlon FROM {out}0)"""


@query(f"WITH {CHINA}, {_gcj_sql('lat', 'lon', 'g', 'china')} SELECT event_id, round(lat+dlat, 7) AS lat, round(lon+dlon, 7) AS lon FROM g")
def gcj02_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = china.wgs84_to_gcj02("lat", "lon")
    return in_china(spark, sf_dir).select("event_id", _r(g["lat"], 7).alias("lat"), _r(g["lon"], 7).alias("lon"))


@query(f"WITH {CHINA}, {_gcj_sql('lat', 'lon', 'g', 'china')} SELECT event_id, round(lat-dlat, 7) AS lat, round(lon-dlon, 7) AS lon FROM g")
def gcj02_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = china.gcj02_to_wgs84_fast("lat", "lon")
    return in_china(spark, sf_dir).select("event_id", _r(g["lat"], 7).alias("lat"), _r(g["lon"], 7).alias("lon"))


@query(f"WITH {CHINA} SELECT event_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM china")
def gcj02_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refined inverse of the forward map gives back the positions."""
    p = in_china(spark, sf_dir).withColumn("g", china.wgs84_to_gcj02("lat", "lon"))
    w = china.gcj02_to_wgs84_refined("g.lat", "g.lon")
    return p.withColumn("w", w).select("event_id", _r(F.col("w.lat"), 7).alias("lat"), _r(F.col("w.lon"), 7).alias("lon"))


@query(f"""WITH {CHINA}, z AS (SELECT *, sqrt(lon*lon+lat*lat) + 0.00002*sin(lat*pi()*3000/180) AS r, atan2(lat, lon) + 0.000003*cos(lon*pi()*3000/180) AS t FROM china)
SELECT event_id, round(r*sin(t)+0.006, 7) AS lat, round(r*cos(t)+0.0065, 7) AS lon FROM z""")
def bd09_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = china.gcj02_to_bd09("lat", "lon")
    return in_china(spark, sf_dir).select("event_id", _r(g["lat"], 7).alias("lat"), _r(g["lon"], 7).alias("lon"))


@query(f"""WITH {CHINA}, s AS (SELECT event_id, lat-0.006 AS y, lon-0.0065 AS x FROM china), z AS (SELECT *, sqrt(x*x+y*y) - 0.00002*sin(y*pi()*3000/180) AS r, atan2(y, x) - 0.000003*cos(x*pi()*3000/180) AS t FROM s)
SELECT event_id, round(r*sin(t), 7) AS lat, round(r*cos(t), 7) AS lon FROM z""")
def bd09_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = china.bd09_to_gcj02_fast("lat", "lon")
    return in_china(spark, sf_dir).select("event_id", _r(g["lat"], 7).alias("lat"), _r(g["lon"], 7).alias("lon"))


@query(f"""WITH {SPREAD} SELECT event_id, round(6378137*radians(lon), 3) + 0.0::DOUBLE AS x_m, round(6378137*ln(tan(pi()/4 + radians(lat)/2)), 3) + 0.0::DOUBLE AS y_m FROM spread""")
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mercator.web_mercator("lat", "lon")
    return spread(spark, sf_dir).select("event_id", _r(m["x_m"], 3).alias("x_m"), _r(m["y_m"], 3).alias("y_m"))


def _tile_sql(z: int) -> str:
    n = 1 << z
    return f"""t AS (SELECT *, CAST(least(floor((lon+180)/360*{n}), {n - 1}) AS BIGINT) AS x,
 CAST(least(greatest(floor((0.5 - ln(tan(pi()/4 + radians(lat)/2))/(2*pi()))*{n}), 0), {n - 1}) AS BIGINT) AS y FROM spread)"""


@query(f"WITH {SPREAD}, {_tile_sql(9)} SELECT x, y, count(*) AS n FROM t GROUP BY x, y")
def tile_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mercator.tile("lat", "lon", 9)
    return spread(spark, sf_dir).groupBy(t["x"].alias("x"), t["y"].alias("y")).agg(F.count("*").alias("n"))


@query(f"""WITH {SPREAD}, {_tile_sql(6)} SELECT event_id, {' || '.join(f"CAST(((x >> {k}) & 1) + 2*((y >> {k}) & 1) AS VARCHAR)" for k in range(5, -1, -1))} AS quadkey, x AS back_x, y AS back_y FROM t""")
def quadkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).select("event_id", mercator.quadkey(mercator.tile("lat", "lon", 6)).alias("quadkey"))
    back = mercator.tile_from_quadkey(F.col("quadkey"))
    return p.select("event_id", "quadkey", back["x"].alias("back_x"), back["y"].alias("back_y"))


@query(f"""WITH {SPREAD}, {_tile_sql(5)}, b AS (SELECT event_id, x, y, CAST(least(floor((CASE WHEN lon+30 > 180 THEN lon+30-360 ELSE lon+30 END + 180)/360*32), 31) AS BIGINT) AS x2 FROM t),
s AS (SELECT *, CASE WHEN x2 < x THEN x2 - x + 32 ELSE x2 - x END AS span FROM b)
SELECT event_id, (x + k) % 32 AS x, y FROM (SELECT *, unnest(generate_series(0, span)) AS k FROM s)""")
def tiles_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    east = F.when(F.col("lon") + 30 > 180, F.col("lon") + 30 - 360).otherwise(F.col("lon") + 30)
    p = spread(spark, sf_dir)
    return p.select("event_id", F.explode(mercator.tiles_covering("lat", "lon", "lat", east, 5)).alias("t")).select("event_id", "t.x", "t.y")


@query(f"""WITH {SPREAD}, u AS (SELECT event_id, lon, 0.5 - ln(tan(pi()/4 + radians(least(lat+5, 84))/2))/(2*pi()) AS y0, 0.5 - ln(tan(pi()/4 + radians(lat)/2))/(2*pi()) AS y1 FROM spread)
SELECT event_id, round(degrees(2*atan(exp(pi()*(1-(y0+y1)))) - pi()/2), 6) + 0.0::DOUBLE AS lat, round(lon + 5 - 360*floor((lon + 185)/360), 6) + 0.0::DOUBLE AS lon, round(least(log2(800.0/512.0/(10.0/360.0)), log2(600.0/512.0/(y1-y0)), 22), 6) AS zoom FROM u""")
def fit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = mercator.fit_bounds("lat", "lon", F.least(F.col("lat") + 5, F.lit(84.0)), core.wrap_longitude(F.col("lon") + 10), 800.0, 600.0)
    p = spread(spark, sf_dir).withColumn("v", v)
    return p.select("event_id", *[_r(F.col(f"v.{k}"), 6).alias(k) for k in ("lat", "lon", "zoom")])


@query(f"""WITH {SPREAD}, u AS (SELECT event_id, (lon+180)/360 AS x, 0.5 - ln(tan(pi()/4 + radians(lat)/2))/(2*pi()) AS y FROM spread),
e AS (SELECT *, (x - 400.0/(512*64))*360 - 180 AS w, (x + 400.0/(512*64))*360 - 180 AS e, least(y + 300.0/(512*64), 1) AS ys, greatest(y - 300.0/(512*64), 0) AS yn FROM u)
SELECT event_id, round(degrees(2*atan(exp(pi()*(1-2*ys))) - pi()/2), 6) + 0.0::DOUBLE AS south, round(w - 360*floor((w+180)/360), 6) + 0.0::DOUBLE AS west,
 round(degrees(2*atan(exp(pi()*(1-2*yn))) - pi()/2), 6) + 0.0::DOUBLE AS north, round(e - 360*floor((e+180)/360), 6) + 0.0::DOUBLE AS east FROM e""")
def viewport_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("v", mercator.viewport_bounds("lat", "lon", 6.0, 800.0, 600.0))
    return p.select("event_id", *[_r(F.col(f"v.{k}"), 6).alias(k) for k in ("south", "west", "north", "east")])


_ECEF = """n AS (SELECT *, 6378137.0/sqrt(1 - e2*sin(radians(lat))*sin(radians(lat))) AS nn FROM (SELECT *, (1/298.257223563::DOUBLE)*(2 - 1/298.257223563::DOUBLE) AS e2, CAST(event_id % 9000 AS DOUBLE) AS h FROM spread)),
x AS (SELECT *, (nn+h)*cos(radians(lat))*cos(radians(lon)) AS x, (nn+h)*cos(radians(lat))*sin(radians(lon)) AS y, (nn*(1-e2)+h)*sin(radians(lat)) AS z FROM n)"""


@query(f"WITH {SPREAD}, {_ECEF} SELECT event_id, round(x,3)+0.0::DOUBLE AS x_m, round(y,3)+0.0::DOUBLE AS y_m, round(z,3)+0.0::DOUBLE AS z_m, round(lat,8)+0.0::DOUBLE AS lat, round(CASE WHEN lon = 180 THEN -180 ELSE lon END,8)+0.0::DOUBLE AS lon, round(h,4) AS height_m FROM x")
def ecef_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("h", (F.col("event_id") % 9000).cast("double"))
    p = p.withColumn("e", geodesy.to_ecef("lat", "lon", "h")).withColumn("g", geodesy.from_ecef("e.x_m", "e.y_m", "e.z_m"))
    return p.select("event_id", *[_r(F.col(f"e.{k}"), 3).alias(k) for k in ("x_m", "y_m", "z_m")], _r(F.col("g.lat"), 8).alias("lat"), _r(F.col("g.lon"), 8).alias("lon"), _r(F.col("g.height_m"), 4).alias("height_m"))


@query(f"""WITH {SPREAD}, {_ECEF}, o AS (SELECT radians(47.0::DOUBLE) AS p0, radians(8.0::DOUBLE) AS l0, 6378137.0/sqrt(1 - ((1/298.257223563::DOUBLE)*(2 - 1/298.257223563::DOUBLE))*power(sin(radians(47.0::DOUBLE)),2)) AS n0),
d AS (SELECT event_id, p0, l0, x - (n0+400)*cos(p0)*cos(l0) AS dx, y - (n0+400)*cos(p0)*sin(l0) AS dy, z - (n0*(1-e2)+400)*sin(p0) AS dz FROM x, o),
q AS (SELECT event_id, -sin(l0)*dx + cos(l0)*dy AS e, -sin(p0)*cos(l0)*dx - sin(p0)*sin(l0)*dy + cos(p0)*dz AS n, cos(p0)*cos(l0)*dx + cos(p0)*sin(l0)*dy + sin(p0)*dz AS u FROM d)
SELECT event_id, round(e,3)+0.0::DOUBLE AS east_m, round(n,3)+0.0::DOUBLE AS north_m, round(u,3)+0.0::DOUBLE AS up_m, round(CASE WHEN atan2(e,n) < 0 THEN degrees(atan2(e,n))+360 ELSE degrees(atan2(e,n)) END,6) AS azimuth_deg,
 round(degrees(atan2(u, sqrt(e*e+n*n))),6) AS elevation_deg, round(sqrt(e*e+n*n+u*u),3) AS range_m FROM q""")
def enu_aer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("h", (F.col("event_id") % 9000).cast("double"))
    p = p.withColumn("e", geodesy.to_enu("lat", "lon", "h", 47.0, 8.0, 400.0)).withColumn("a", geodesy.enu_to_aer(F.col("e")))
    return p.select("event_id", *[_r(F.col(f"e.{k}"), 3).alias(k) for k in ("east_m", "north_m", "up_m")], _r(F.col("a.azimuth_deg"), 6).alias("azimuth_deg"), _r(F.col("a.elevation_deg"), 6).alias("elevation_deg"), _r(F.col("a.range_m"), 3).alias("range_m"))


@query()
def helmert_datum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokyo positions in WGS-84 and back; ``tokyo_to_wgs84`` holds the way there to SQL."""
    p = spread(spark, sf_dir).withColumn("w", geodesy.shift_datum("lat", "lon", core.TOKYO)).withColumn("t", geodesy.shift_datum("w.lat", "w.lon", core.WGS84, core.TOKYO))
    return p.select("event_id", _r(F.col("w.lat"), 7).alias("lat"), _r(F.col("w.lon"), 7).alias("lon"), _r(F.col("t.lat"), 5).alias("back_lat"))


@query()
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM and back; ``utm_roundtrip`` holds the way back to the positions, ``mgrs_squares`` the series to SQL."""
    p = spread(spark, sf_dir).withColumn("u", grids.utm("lat", "lon")).withColumn("g", grids.utm_inverse(F.col("u")))
    return p.select("event_id", "u.zone", "u.hemi", _r(F.col("u.easting_m"), 2).alias("easting_m"), _r(F.col("u.northing_m"), 2).alias("northing_m"), _r(F.col("g.lat"), 7).alias("lat"))


@query(f"""WITH {SPREAD}, z AS (SELECT event_id, lat, CASE WHEN lon = 180 THEN -180 ELSE lon END AS lon FROM spread)
SELECT event_id, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat >= 72 AND lon >= 21 AND lon < 33 THEN 35
 WHEN lat >= 72 AND lon >= 33 AND lon < 42 THEN 37 ELSE CAST(floor((lon+180)/6) AS INT) + 1 END AS zone FROM z""")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir).select("event_id", grids.utm_zone("lat", "lon").alias("zone"))


_PLUS = "'23456789CFGHJMPQRVWX'"


@query(f"""WITH {SPREAD}, v AS (SELECT event_id, CAST(floor(lat*25000000) AS BIGINT) + 2250000000 AS y, (CAST(floor((CASE WHEN lon = 180 THEN -180 ELSE lon END)*8192000) AS BIGINT) + 1474560000) % 2949120000 AS x FROM spread)
SELECT event_id, {' || '.join(f"substr({_PLUS}, CAST((y // {3125 * 20 ** (4 - k)}) % 20 + 1 AS INT), 1) || substr({_PLUS}, CAST((x // {1024 * 20 ** (4 - k)}) % 20 + 1 AS INT), 1)" + (" || '+'" if k == 3 else '') for k in range(5))}
 || substr({_PLUS}, CAST(((y // 625) % 5)*4 + (x // 256) % 4 + 1 AS INT), 1) AS code FROM v""")
def plus_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir).select("event_id", grids.plus_code("lat", "lon", 11).alias("code"))


@query(f"""WITH {SPREAD}, v AS (SELECT event_id, CASE WHEN lon = 180 THEN 0 ELSE lon + 180 END AS x, lat + 90 AS y FROM spread)
SELECT event_id, chr(CAST(65 + floor(x/20) AS INT)) || chr(CAST(65 + floor(y/10) AS INT)) || CAST(CAST(floor((x - floor(x/20)*20)/2) AS INT) AS VARCHAR) || CAST(CAST(floor(y - floor(y/10)*10) AS INT) AS VARCHAR) AS locator FROM v""")
def maidenhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir).select("event_id", grids.maidenhead("lat", "lon", 2).alias("locator"))


@query(f"""WITH {SPREAD}, v AS (SELECT event_id, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM spread),
a AS (SELECT cos(radians(10.0::DOUBLE))*cos(radians(20.0::DOUBLE)) AS ax, cos(radians(10.0::DOUBLE))*sin(radians(20.0::DOUBLE)) AS ay, sin(radians(10.0::DOUBLE)) AS az, cos(radians(50.0::DOUBLE))*cos(radians(80.0::DOUBLE)) AS bx, cos(radians(50.0::DOUBLE))*sin(radians(80.0::DOUBLE)) AS by_, sin(radians(50.0::DOUBLE)) AS bz),
p AS (SELECT *, ay*bz - az*by_ AS nx, az*bx - ax*bz AS ny, ax*by_ - ay*bx AS nz FROM a), s AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS nn FROM p)
SELECT event_id, round(-asin(greatest(-1, least(1, (nx*x+ny*y+nz*z)/nn)))*6371008.8, 2) + 0.0::DOUBLE AS cross_m,
 round(atan2(x*(ny*az-nz*ay)/nn + y*(nz*ax-nx*az)/nn + z*(nx*ay-ny*ax)/nn, x*ax+y*ay+z*az)*6371008.8, 2) + 0.0::DOUBLE AS along_m FROM v, s""")
def cross_track_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = (10.0, 20.0, 50.0, 80.0)
    return spread(spark, sf_dir).select(
        "event_id", _r(geodesy.cross_track_spherical("lat", "lon", *path), 2).alias("cross_m"), _r(geodesy.along_track_spherical("lat", "lon", *path), 2).alias("along_m")
    )


@query("""WITH v AS (SELECT user_id, event_id AS idx, ts AS arrival, ts + INTERVAL 5 MINUTE AS departure FROM events),
m AS (SELECT *, max(departure) OVER (PARTITION BY user_id ORDER BY arrival, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM v),
t AS (SELECT *, sum(CASE WHEN until IS NULL OR arrival - until > INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY arrival, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS trip FROM m)
SELECT user_id, CAST(trip AS BIGINT) AS trip, count(*) AS n_visits, epoch_us(min(arrival)) AS start_us, epoch_us(max(departure)) AS end_us FROM t GROUP BY user_id, trip""")
def trips_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("idx"), F.col("ts").alias("arrival"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("departure"))
    t = segment_trips(v, 4 * 3600.0, ["user_id"])
    return t.select("user_id", "trip", "n_visits", _us("start").alias("start_us"), _us("end").alias("end_us"))


def _us(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but the purchases as fixes of its user's track, one for each instant."""
    p = spread(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).where("event_id % 3 != 0")
    return p.groupBy(F.col("user_id").alias("track_id"), "ts").agg(F.min(F.struct("event_id", "lat", "lon")).alias("m")).select("track_id", "ts", "m.lat", "m.lon")


@query(f"""WITH {SPREAD}, f AS (SELECT user_id, ts, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon FROM spread WHERE event_id % 3 != 0 GROUP BY user_id, ts),
q AS (SELECT event_id, user_id, ts FROM spread WHERE event_id % 3 = 0),
b AS (SELECT q.*, f.ts AS t1, f.lat AS a1, f.lon AS o1 FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.ts >= f.ts),
n AS (SELECT b.*, f.ts AS t2, f.lat AS a2, f.lon AS o2 FROM b ASOF LEFT JOIN f ON b.user_id = f.user_id AND b.ts <= f.ts),
w AS (SELECT *, epoch_us(ts) - epoch_us(t1) AS d1, epoch_us(t2) - epoch_us(ts) AS d2 FROM n),
c AS (SELECT *, CASE WHEN t1 = ts THEN 'matched' WHEN t1 IS NOT NULL AND t2 IS NOT NULL AND d1 + d2 <= 36000000000 THEN 'interpolated' WHEN t1 IS NOT NULL AND d1 <= 7200000000 AND (t2 IS NULL OR d1 <= d2) THEN 'held1' WHEN t2 IS NOT NULL AND d2 <= 7200000000 THEN 'held2' END AS k FROM w),
g AS (SELECT *, {_hav('a1', 'o1', 'a2', 'o2')}/6371008.8 AS arc, CAST(d1 AS DOUBLE)/CAST(d1+d2 AS DOUBLE) AS fr FROM c),
i AS (SELECT *, sin((1-fr)*arc)/sin(arc) AS p, sin(fr*arc)/sin(arc) AS q_ FROM g),
x AS (SELECT *, p*cos(radians(a1))*cos(radians(o1)) + q_*cos(radians(a2))*cos(radians(o2)) AS x, p*cos(radians(a1))*sin(radians(o1)) + q_*cos(radians(a2))*sin(radians(o2)) AS y, p*sin(radians(a1)) + q_*sin(radians(a2)) AS z FROM i)
SELECT event_id, round(CASE WHEN k IN ('matched','held1') THEN a1 WHEN k = 'held2' THEN a2 WHEN k = 'interpolated' THEN degrees(atan2(z, sqrt(x*x+y*y))) END, 6) AS lat,
 round(CASE WHEN k IN ('matched','held1') THEN o1 WHEN k = 'held2' THEN o2 WHEN k = 'interpolated' THEN degrees(atan2(y, x)) END, 6) AS lon, CASE WHEN k LIKE 'held%' THEN 'held' ELSE k END AS how FROM x""")
def asof_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spread(spark, sf_dir).where("event_id % 3 = 0").select("event_id", F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"))
    return asof_locate(_fixes(spark, sf_dir), asked, 36000.0, 7200.0).select("event_id", _r(F.col("lat"), 6).alias("lat"), _r(F.col("lon"), 6).alias("lon"), "how")


_METERS = """sqrt(power(6378137.0::DOUBLE*(1-0.0066943799901413165)/power(1-0.0066943799901413165*power(sin(radians((a1+a2)/2)),2), 1.5)*radians(a2-a1), 2)
 + power(6378137.0::DOUBLE/sqrt(1-0.0066943799901413165*power(sin(radians((a1+a2)/2)),2))*cos(radians((a1+a2)/2))*radians(o2-o1), 2))"""


@query(f"""WITH {TOWN}, f AS (SELECT user_id, ts, arg_min(event_id, event_id) AS e, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon FROM town WHERE event_type <> 'purchase' GROUP BY user_id, ts),
q AS (SELECT event_id, user_id, ts FROM town),
b AS (SELECT q.*, f.ts AS t1, f.e AS e1, f.lat AS a1, f.lon AS o1 FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.ts >= f.ts),
n AS (SELECT b.*, f.ts AS t2, f.e AS e2, f.lat AS a2, f.lon AS o2 FROM b ASOF LEFT JOIN f ON b.user_id = f.user_id AND b.ts <= f.ts),
w AS (SELECT *, (epoch_us(ts) - epoch_us(t1))/1e6 AS d1, (epoch_us(t2) - epoch_us(ts))/1e6 AS d2, {_METERS} AS m FROM n),
c AS (SELECT *, CASE WHEN t1 = ts THEN 'matched' WHEN t1 IS NOT NULL AND t2 IS NOT NULL AND d1 + d2 <= 36000 THEN 'interpolated' WHEN t1 IS NOT NULL AND d1 <= 7200 AND (t2 IS NULL OR d1 <= d2) THEN 'held1' WHEN t2 IS NOT NULL AND d2 <= 7200 THEN 'held2' END AS k,
  CASE WHEN e1 % 4 > 0 THEN CAST(e1 % 9 AS DOUBLE) END AS acc1, CASE WHEN e2 % 4 > 0 THEN CAST(e2 % 9 AS DOUBLE) END AS acc2, CASE WHEN e1 % 5 > 0 THEN CAST(e1 % 100 AS DOUBLE) END AS h1, CASE WHEN e2 % 5 > 0 THEN CAST(e2 % 100 AS DOUBLE) END AS h2 FROM w)
SELECT event_id, CASE WHEN k LIKE 'held%' THEN 'extrapolated' ELSE k END AS how,
 floor(10*CASE WHEN k IN ('matched', 'held1') THEN coalesce(acc1, 0) + 0.01*d1 WHEN k = 'held2' THEN coalesce(acc2, 0) + 0.01*d2 WHEN k = 'interpolated' THEN least(coalesce(acc1, 0) + 0.01*d1 + m*d1/(d1+d2), coalesce(acc2, 0) + 0.01*d2 + m*d2/(d1+d2)) END + 0.31415)::BIGINT AS accuracy_dm,
 CASE WHEN k IN ('matched', 'held1') THEN CASE WHEN acc1 IS NOT NULL AND e1 % 2 = 0 THEN 'bound' ELSE 'unspecified' END WHEN k = 'held2' THEN CASE WHEN acc2 IS NOT NULL AND e2 % 2 = 0 THEN 'bound' ELSE 'unspecified' END
  WHEN k = 'interpolated' THEN CASE WHEN acc1 IS NOT NULL AND acc2 IS NOT NULL AND e1 % 2 = 0 AND e2 % 2 = 0 THEN 'bound' ELSE 'unspecified' END END AS accuracy_kind,
 floor(1000*CASE WHEN k IN ('matched', 'held1') THEN h1 WHEN k = 'held2' THEN h2 WHEN k = 'interpolated' AND e1 % 3 = e2 % 3 THEN h1 + (h2-h1)*d1/(d1+d2) END + 0.31415)::BIGINT AS height_mm FROM c""")
def located_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events placed on the tracks of those that are no purchases, with accuracy and height."""
    p, e = town(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    tracks = p.where("event_type != 'purchase'").select(
        F.col("user_id").alias("track_id"), e.alias("idx"), "ts", "lat", "lon", F.when(e % 4 > 0, (e % 9).cast("double")).alias("accuracy_m"), F.when(e % 2 == 0, "bound").otherwise("guess").alias("accuracy_kind"),
        F.when(e % 5 > 0, (e % 100).cast("double")).alias("height_m"), (e % 3).cast("string").alias("height_kind"),
    )
    got = locate_fixes(tracks, p.select("event_id", F.col("user_id").alias("track_id"), "ts"), 36000.0, 7200.0, max_speed_mps=0.01)
    return got.select("event_id", "how", F.floor(F.col("accuracy_m") * 10 + 0.31415).alias("accuracy_dm"), "accuracy_kind", F.floor(F.col("height_m") * 1000 + 0.31415).alias("height_mm"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("bigint").alias("idx"), _d((k * 7919) % 1601, 10, 80).alias("lat"), _d((k * 15485863) % 3601, 10, 180).alias("lon"),
        (k % 7).cast("int").alias("class"), (k * 1000).cast("bigint").alias("population"),
    )


PLACES = """places AS (SELECT CAST(s_suppkey AS BIGINT) AS idx, CAST((s_suppkey*7919) % 1601 AS DOUBLE)/CAST(10 AS DOUBLE) - CAST(80 AS DOUBLE) AS lat,
 CAST((CAST(s_suppkey AS BIGINT)*15485863) % 3601 AS DOUBLE)/CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon, s_suppkey % 7 AS class, s_suppkey*1000 AS population FROM supplier)"""


@query(f"""WITH {SPREAD}, {PLACES} SELECT s.event_id AS qid, p.idx AS pid, round({_hav('s.lat','s.lon','p.lat','p.lon')}, 2) AS distance_m FROM spread s JOIN places p ON {_hav('s.lat','s.lon','p.lat','p.lon')} <= 400000""")
def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spread(spark, sf_dir).select(F.col("event_id").alias("qid"), "lat", "lon")
    return radius_join(q, _places(spark, sf_dir).withColumnRenamed("idx", "pid"), 400000.0).select("qid", "pid", _r(F.col("distance_m"), 2).alias("distance_m"))


@query(f"""WITH {SPREAD}, {PLACES}, d AS (SELECT s.event_id AS qid, p.idx AS pid, {_hav('s.lat','s.lon','p.lat','p.lon')} AS m FROM spread s, places p WHERE s.event_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, pid) AS rank FROM d) SELECT qid, pid, round(m, 2) AS distance_m, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def nearest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spread(spark, sf_dir).where("event_id % 20 = 0").select(F.col("event_id").alias("qid"), "lat", "lon")
    return knn_join(q, _places(spark, sf_dir).withColumnRenamed("idx", "pid"), 3, 500_000.0).select("qid", "pid", _r(F.col("distance_m"), 2).alias("distance_m"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {SPREAD}, {PLACES}, d AS (SELECT s.event_id AS qid, p.idx AS pid, {_hav('s.lat','s.lon','p.lat','p.lon')} AS m FROM spread s JOIN places p ON p.class >= 2 AND p.population >= 10000 AND {_hav('s.lat','s.lon','p.lat','p.lon')} <= 900000),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, pid) AS rn FROM d) SELECT s.event_id AS qid, r.pid AS place_idx, round(r.m, 2) AS distance_m FROM spread s LEFT JOIN r ON r.qid = s.event_id AND r.rn = 1""")
def reverse_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spread(spark, sf_dir).select(F.col("event_id").alias("qid"), "lat", "lon")
    return reverse_lookup(q, _places(spark, sf_dir), 900_000.0, 10_000, 2).select("qid", "place_idx", _r(F.col("distance_m"), 2).alias("distance_m"))


@query(f"""WITH {SPREAD}, {PLACES}, z AS (SELECT lat, lon, CAST(50000 * (1 + idx % 8) AS DOUBLE) AS radius FROM places)
SELECT event_id FROM spread s WHERE NOT EXISTS (SELECT 1 FROM z WHERE {_hav('s.lat','s.lon','z.lat','z.lon')} <= z.radius)""")
def zones_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = _places(spark, sf_dir).select(F.col("idx").alias("zone_id"), "lat", "lon", ((F.col("idx") % 8 + 1) * 50000.0).alias("radius_m"))
    return zones_strip(spread(spark, sf_dir).withColumnRenamed("event_id", "idx"), zones).select(F.col("idx").alias("event_id"))


@query(f"""WITH RECURSIVE {TOWN}, e AS (SELECT a.event_id AS a, b.event_id AS b, {_hav('a.lat','a.lon','b.lat','b.lon')} AS m FROM town a JOIN town b ON abs(a.lat-b.lat) < 0.001 AND {_hav('a.lat','a.lon','b.lat','b.lon')} <= 25),
k AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4), g AS (SELECT e.a, e.b FROM e JOIN k x ON x.a = e.a JOIN k y ON y.a = e.b),
reach AS (SELECT a AS id, a AS r FROM k UNION SELECT g.b, reach.r FROM reach JOIN g ON g.a = reach.id AND g.b > reach.r), c AS (SELECT id, min(r) AS comp FROM reach GROUP BY id)
SELECT t.event_id AS idx, c.id IS NOT NULL AS is_core, coalesce(e2.near, FALSE) AS clustered FROM town t LEFT JOIN c ON c.id = t.event_id
LEFT JOIN (SELECT e.a, TRUE AS near FROM e JOIN k ON k.a = e.b GROUP BY e.a) e2 ON e2.a = t.event_id""")
def dbscan_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events are cores and which are in a cluster; numbering and border ties are held to brute force in tests."""
    d = dbscan(town(spark, sf_dir).withColumnRenamed("event_id", "idx"), 25.0, 4)
    return d.select("idx", "is_core", F.col("cluster_id").isNotNull().alias("clustered"))


#: Where each run ends and what begins after it: a table that a recursion walks from each track's first fix.
_VISITS = f"""{TOWN}, o AS MATERIALIZED (SELECT user_id, event_id, ts, lat, lon, row_number() OVER (PARTITION BY user_id ORDER BY ts, lat, lon, event_id) AS k FROM town),
far AS (SELECT a.user_id, a.k, min(b.k) AS stop FROM o a JOIN o b ON a.user_id = b.user_id AND b.k > a.k AND {_hav('a.lat','a.lon','b.lat','b.lon')} > 150 GROUP BY a.user_id, a.k),
run AS MATERIALIZED (SELECT o.user_id, o.k, o.event_id AS anchor_idx, o.ts AS arrival, e.ts AS departure, e.k + 1 AS stop, epoch_us(e.ts) - epoch_us(o.ts) >= 1800000000 AS stays
  FROM o LEFT JOIN far USING (user_id, k) JOIN (SELECT user_id, max(k) AS n FROM o GROUP BY user_id) s ON s.user_id = o.user_id JOIN o e ON e.user_id = o.user_id AND e.k = coalesce(far.stop - 1, s.n)),
walk AS (SELECT user_id, 1::BIGINT AS k FROM o WHERE k = 1 UNION ALL SELECT w.user_id, CASE WHEN r.stays THEN r.stop ELSE r.k + 1 END FROM walk w JOIN run r USING (user_id, k)),
visit AS MATERIALIZED (SELECT run.* FROM walk JOIN run USING (user_id, k) WHERE stays)"""


def _timed_town(spark: SparkSession, sf_dir: str) -> DataFrame:
    return town(spark, sf_dir).select(F.col("user_id").alias("track_id"), F.col("event_id").alias("idx"), F.col("ts").cast("timestamp").alias("ts"), "lat", "lon")


@query(f"""WITH RECURSIVE {_VISITS} SELECT user_id AS track_id, epoch_us(arrival) AS arrival_us, epoch_us(departure) AS departure_us, stop - k AS n_fixes, anchor_idx FROM visit""")
def stay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stay points of every user."""
    v = segment_visits(_timed_town(spark, sf_dir), 150.0, 1800.0)
    return v.select("track_id", _us("arrival").alias("arrival_us"), _us("departure").alias("departure_us"), "n_fixes", "anchor_idx")


@query(f"""WITH RECURSIVE {_VISITS}, m AS (SELECT v.anchor_idx, o.* FROM visit v JOIN o ON o.user_id = v.user_id AND o.k >= v.k AND o.k < v.stop),
s AS (SELECT anchor_idx, user_id, count(*) AS n, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, sum(cos(radians(lat))*cos(radians(lon))) AS x, sum(cos(radians(lat))*sin(radians(lon))) AS y, sum(sin(radians(lat))) AS z FROM m GROUP BY anchor_idx, user_id),
c AS (SELECT *, x/sqrt(x*x+y*y+z*z) AS cx, y/sqrt(x*x+y*y+z*z) AS cy, z/sqrt(x*x+y*y+z*z) AS cz FROM s),
b AS (SELECT c.anchor_idx, max(sqrt(power(cos(radians(lat))*cos(radians(lon))-cx, 2) + power(cos(radians(lat))*sin(radians(lon))-cy, 2) + power(sin(radians(lat))-cz, 2))) AS chord FROM c JOIN m USING (anchor_idx) GROUP BY c.anchor_idx)
SELECT user_id AS track_id, anchor_idx, n AS n_fixes, floor(degrees(atan2(z, sqrt(x*x+y*y)))*1000000 + 0.31415)::BIGINT AS lat_e6, floor(degrees(atan2(y, x))*1000000 + 0.31415)::BIGINT AS lon_e6,
 round(2*asin(chord/2)*6378137.0*6378137.0/6356752.314245179, 2) AS max_error_m, round(south, 7) + 0.0::DOUBLE AS south, round(west, 7) + 0.0::DOUBLE AS west, round(north, 7) + 0.0::DOUBLE AS north, round(east, 7) + 0.0::DOUBLE AS east FROM c JOIN b USING (anchor_idx)""")
def visit_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, mean position, bound and box of every stay point."""
    v = visit_summaries(visit_members(_timed_town(spark, sf_dir), 150.0, 1800.0))
    e6 = lambda k: F.floor(F.col(k) * 1000000 + 0.31415).alias(f"{k}_e6")
    return v.select("track_id", "anchor_idx", "n_fixes", e6("lat"), e6("lon"), *[_r(F.col(k), d).alias(k) for k, d in (("max_error_m", 2), ("south", 7), ("west", 7), ("north", 7), ("east", 7))])


@query(f"""WITH RECURSIVE {_VISITS} SELECT v.user_id AS track_id, v.anchor_idx, o.event_id AS idx FROM visit v JOIN o ON o.user_id = v.user_id AND o.k >= v.k AND o.k < v.stop""")
def visit_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes of every stay point, a row each."""
    return visit_members(_timed_town(spark, sf_dir), 150.0, 1800.0).select("track_id", "anchor_idx", "idx")


@query(f"""WITH {SPREAD}, k AS (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 3 END AS k, lat, lon FROM spread),
x AS (SELECT DISTINCT k, CASE WHEN lon = 180 THEN -180 ELSE lon END AS x FROM k WHERE abs(lat) < 90),
g AS (SELECT k, x, lag(x) OVER (PARTITION BY k ORDER BY x) AS b FROM x), m AS (SELECT k, min(x) AS f, max(x) AS l, arg_max(b, (x - b, -x)) FILTER (WHERE b IS NOT NULL) AS e, arg_max(x, (x - b, -x)) FILTER (WHERE b IS NOT NULL) AS w, max(x - b) AS gap FROM g GROUP BY k),
s AS (SELECT k, min(lat) AS south, max(lat) AS north, count(*) AS n, sum(cos(radians(lat))*cos(radians(lon))) AS vx, sum(cos(radians(lat))*sin(radians(lon))) AS vy, sum(sin(radians(lat))) AS vz FROM k GROUP BY k)
SELECT s.k, n, round(south, 7) + 0.0::DOUBLE AS south, round(north, 7) + 0.0::DOUBLE AS north, round(CASE WHEN coalesce(gap, -1) <= f + 360 - l THEN f ELSE w END, 7) + 0.0::DOUBLE AS west, round(CASE WHEN coalesce(gap, -1) <= f + 360 - l THEN l ELSE e END, 7) + 0.0::DOUBLE AS east,
 round(degrees(atan2(vz, sqrt(vx*vx+vy*vy))), 6) + 0.0::DOUBLE AS lat, round(degrees(atan2(vy, vx)), 6) + 0.0::DOUBLE AS lon FROM s JOIN m ON s.k IS NOT DISTINCT FROM m.k""")
def boxes_of_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and centres of groups of which one has no key and a third of all rows."""
    p = spread(spark, sf_dir).select(F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 3).alias("k"), "lat", "lon")
    r = lambda k, d: _r(F.col(k), d).alias(k)
    both = bounds_agg(p, ["k"]).withColumnRenamed("k", "b").join(centroid_agg(p, ["k"]), F.col("b").eqNullSafe(F.col("k")))
    return both.select("k", "n", r("south", 7), r("north", 7), r("west", 7), r("east", 7), r("lat", 6), r("lon", 6))


@query(f"""WITH {SPREAD}, x AS (SELECT DISTINCT CASE WHEN lon = 180 THEN -180 ELSE lon END AS x FROM spread), g AS (SELECT x, lag(x) OVER (ORDER BY x) AS b FROM x),
m AS (SELECT min(x) AS f, max(x) AS l, arg_max(b, (x - b, -x)) FILTER (WHERE b IS NOT NULL) AS e, arg_max(x, (x - b, -x)) FILTER (WHERE b IS NOT NULL) AS w, max(x - b) AS gap FROM g),
s AS (SELECT count(*) AS n, min(lat) AS south, max(lat) AS north, sum(cos(radians(lat))*cos(radians(lon))) AS vx, sum(cos(radians(lat))*sin(radians(lon))) AS vy, sum(sin(radians(lat))) AS vz FROM spread)
SELECT n, round(south, 7) + 0.0::DOUBLE AS south, round(north, 7) + 0.0::DOUBLE AS north, round(CASE WHEN gap <= f + 360 - l THEN f ELSE w END, 7) + 0.0::DOUBLE AS west, round(CASE WHEN gap <= f + 360 - l THEN l ELSE e END, 7) + 0.0::DOUBLE AS east,
 round(degrees(atan2(vz, sqrt(vx*vx+vy*vy))), 6) + 0.0::DOUBLE AS lat, round(degrees(atan2(vy, vx)), 6) + 0.0::DOUBLE AS lon FROM s, m""")
def box_of_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and centre of the whole table, without a key."""
    p = spread(spark, sf_dir)
    r = lambda k, d: _r(F.col(k), d).alias(k)
    return bounds_agg(p, []).join(centroid_agg(p, []), F.lit(True)).select("n", r("south", 7), r("north", 7), r("west", 7), r("east", 7), r("lat", 6), r("lon", 6))


@query(f"""WITH {SPREAD}, {_geohash_sql(6)} SELECT event_id, cell, round(floor((lat+90)/180*32768)*180/32768 - 90, 7) AS south, round(least(floor((lon+180)/360*32768), 32767)*360/32768 - 180, 7) AS west FROM h""")
def geohash_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("cell", grids.geohash("lat", "lon", 6)).withColumn("b", grids.geohash_bounds(F.col("cell")))
    return p.select("event_id", "cell", _r(F.col("b.south"), 7).alias("south"), _r(F.col("b.west"), 7).alias("west"))


@query(f"""WITH {SPREAD}, s AS (SELECT event_id, lat, lon, printf('%.4f', abs(lat)) AS a4, printf('%.4f', abs(lon)) AS b4 FROM spread)
SELECT event_id, (CASE WHEN lat < 0 AND a4 <> '0.0000' THEN '-' ELSE '' END) || a4 || ', ' || (CASE WHEN lon < 0 AND b4 <> '0.0000' THEN '-' ELSE '' END) || b4 AS point,
 replace(a4, '.', ',') || (CASE WHEN lat < 0 AND a4 <> '0.0000' THEN ' S ' ELSE ' N ' END) || replace(b4, '.', ',') || (CASE WHEN lon < 0 AND b4 <> '0.0000' THEN ' W' ELSE ' E' END) AS comma FROM s""")
def format_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir).select(
        "event_id", text.format_dd("lat", "lon", 4).alias("point"), text.format_dd("lat", "lon", 4, cardinal=True, separator=",").alias("comma")
    )


def _dms_sql(v: str, letters: str) -> str:
    """Whole tenths of a second in SQL, so that a carry needs no case of its own."""
    t = f"CAST(floor(abs({v}) * 3600 * 10 + 0.5) AS BIGINT)"
    return (
        f"CAST({t} // 36000 AS VARCHAR) || '°' || lpad(CAST({t} // 600 % 60 AS VARCHAR), 2, '0') || '′' || lpad(CAST({t} // 10 % 60 AS VARCHAR), 2, '0') || '.' || "
        f"CAST({t} % 10 AS VARCHAR) || '″' || CASE WHEN {v} < 0 AND {t} > 0 THEN '{letters[1]}' ELSE '{letters[0]}' END"
    )


def _ddm_sql(v: str, letters: str) -> str:
    t = f"CAST(floor(abs({v}) * 60 * 1000 + 0.5) AS BIGINT)"
    return (
        f"CAST({t} // 60000 AS VARCHAR) || 'd' || lpad(CAST({t} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({t} % 1000 AS VARCHAR), 3, '0') || 'm' || "
        f"CASE WHEN {v} < 0 AND {t} > 0 THEN '{letters[1]}' ELSE '{letters[0]}' END"
    )


@query(f"""WITH {SPREAD}, p AS (SELECT event_id, lat + 0.000011 AS lat, lon + 0.000011 AS lon FROM spread)
SELECT event_id, {_dms_sql('lat', 'NS')} || ' ' || {_dms_sql('lon', 'EW')} AS dms, {_ddm_sql('lat', 'NS')} || ' ' || {_ddm_sql('lon', 'EW')} AS ddm FROM p""")
def format_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions moved off the grid on which seconds end in five, where the two engines could round apart."""
    p = spread(spark, sf_dir).select("event_id", (F.col("lat") + 0.000011).alias("lat"), (F.col("lon") + 0.000011).alias("lon"))
    return p.select("event_id", text.format_dms("lat", "lon", 1).alias("dms"), text.format_ddm("lat", "lon", 3, "letters").alias("ddm"))


@query(f"""WITH {SPREAD} SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(lat, 9) + 0.0::DOUBLE END AS lat, CASE WHEN event_id % 7 <> 0 THEN round(lon, 9) + 0.0::DOUBLE END AS lon,
 CASE WHEN event_id % 7 = 1 THEN 4.5::DOUBLE END AS horizontal_m, CASE WHEN event_id % 7 = 1 THEN CAST(event_id AS DOUBLE) END AS height_m, CASE WHEN event_id % 7 = 0 THEN 'NoFix' END AS error_kind FROM spread""")
def nmea_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event written as a sentence (one in seven a GGA, one in seven a void RMC, the others GLL) and read again."""
    size = lambda v: F.abs(F.col(v))
    field = lambda v, d: F.concat(F.format_string(f"%0{d}d", F.floor(size(v))), F.format_string("%011.8f", (size(v) - F.floor(size(v))) * 60.0))
    letter = lambda v, plus, minus: F.when(F.col(v) < 0, minus).otherwise(plus)
    at = F.concat_ws(",", field("lat", 2), letter("lat", "N", "S"), field("lon", 3), letter("lon", "E", "W"))
    turn = F.col("event_id") % 7
    sentence = (
        F.when(turn == 0, F.concat(F.lit("$GPRMC,123519,V,"), at, F.lit(",0,0,010124,,")))
        .when(turn == 1, F.concat(F.lit("$GNGGA,123519,"), at, F.lit(",1,08,0.9,"), F.col("event_id").cast("string"), F.lit(",M,46.9,M,,")))
        .otherwise(F.concat(F.lit("$GPGLL,"), at, F.lit(",123519,A")))
    )
    p = spread(spark, sf_dir).select("event_id", parse_nmea(sentence).alias("p"))
    return p.select("event_id", _r(F.col("p.lat"), 9).alias("lat"), _r(F.col("p.lon"), 9).alias("lon"), "p.horizontal_m", "p.height_m", "p.error_kind")


@query(f"""WITH {SPREAD} SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN lat + 0.0::DOUBLE END AS lat, CASE WHEN event_id % 5 <> 0 THEN lon + 0.0::DOUBLE END AS lon,
 CASE WHEN event_id % 5 = 1 THEN 12.5::DOUBLE END AS horizontal_m, CASE WHEN event_id % 5 = 2 THEN 1 WHEN event_id % 5 <> 0 THEN 0 END AS n_notes, CASE WHEN event_id % 5 = 0 THEN 'Unsupported' END AS error_kind FROM spread""")
def geo_uri_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event written as a geo: URI, with an uncertainty, an unknown parameter or a foreign crs in turn, and read again."""
    turn = F.col("event_id") % 5
    tail = F.when(turn == 0, ";crs=nad27").when(turn == 1, ";crs=WGS84;u=12.5").when(turn == 2, ";z=1").otherwise("")
    uri = F.concat(F.lit("geo:"), F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"), tail)
    p = spread(spark, sf_dir).select("event_id", parse_geo_uri(uri).alias("p"))
    return p.select("event_id", "p.lat", "p.lon", "p.horizontal_m", F.when(F.col("p.notes").isNotNull(), F.size("p.notes")).alias("n_notes"), "p.error_kind")


@query(f"""WITH RECURSIVE {SPREAD}, d AS (SELECT event_id, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM spread),
f AS (SELECT event_id, CASE WHEN abs(x) > abs(y) AND abs(x) > abs(z) THEN (CASE WHEN x >= 0 THEN 0 ELSE 3 END) WHEN abs(y) > abs(z) THEN (CASE WHEN y >= 0 THEN 1 ELSE 4 END) ELSE (CASE WHEN z >= 0 THEN 2 ELSE 5 END) END AS face, x, y, z FROM d),
u AS (SELECT event_id, face, CASE face WHEN 0 THEN y/x WHEN 1 THEN -x/y WHEN 2 THEN -x/z WHEN 3 THEN z/x WHEN 4 THEN z/y ELSE -y/z END AS u, CASE face WHEN 0 THEN z/x WHEN 1 THEN z/y WHEN 2 THEN -y/z WHEN 3 THEN y/x WHEN 4 THEN -x/y ELSE -x/z END AS v FROM f),
g AS (SELECT event_id, face, CAST(floor((CASE WHEN u >= 0 THEN 0.5*sqrt(1+3*u) ELSE 1-0.5*sqrt(1-3*u) END) * 4096) AS BIGINT) AS i, CAST(floor((CASE WHEN v >= 0 THEN 0.5*sqrt(1+3*v) ELSE 1-0.5*sqrt(1-3*v) END) * 4096) AS BIGINT) AS j FROM u),
h AS (SELECT event_id, face, i, j, 11 AS k, CAST(face AS BIGINT) AS id, face % 2 AS turn FROM g UNION ALL
 SELECT event_id, face, i, j, k - 1, id * 4 + p, xor(turn, CASE p WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 0 END) FROM (SELECT *, list_extract([[0,1,3,2],[0,3,1,2],[2,3,1,0],[2,1,3,0]][turn+1], ((i >> k) & 1) * 2 + ((j >> k) & 1) + 1) AS p FROM h WHERE k >= 0))
SELECT id, count(*) AS n, min(event_id) AS first_idx FROM h WHERE k = -1 GROUP BY id""")
def s2_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by S2 cell of level 12; ``id`` is the face and the curve's place, without the bits that mark the level."""
    cell = grids.s2_cell("lat", "lon", 12)
    return spread(spark, sf_dir).groupBy(F.shiftrightunsigned(cell, 37).alias("id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_idx"))


@query(f"""WITH {SPREAD}, z AS (SELECT event_id, lat, l, CASE WHEN lat >= 56 AND lat < 64 AND l >= 3 AND l < 12 THEN 32 WHEN lat >= 72 AND l >= 0 AND l < 9 THEN 31 WHEN lat >= 72 AND l >= 9 AND l < 21 THEN 33 WHEN lat >= 72 AND l >= 21 AND l < 33 THEN 35
 WHEN lat >= 72 AND l >= 33 AND l < 42 THEN 37 ELSE CAST(floor((l+180)/6) AS INT) + 1 END AS zone FROM (SELECT event_id, lat, CASE WHEN lon = 180 THEN -180 ELSE lon END AS l FROM spread)),
n AS (SELECT *, 1/298.257223563/(2-1/298.257223563) AS n, radians(l - (zone*6-183)) AS d FROM z), t AS (SELECT *, 2*sqrt(n)/(1+n) AS k FROM n), c AS (SELECT *, sinh(atanh(sin(radians(lat))) - k*atanh(k*sin(radians(lat)))) AS t FROM t),
q AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d)/sqrt(1+t*t)) AS eta, 6378137/(1+n)*(1+n*n/4+n**4/64)*0.9996 AS r, n/2-2*n**2/3+5*n**3/16+41*n**4/180 AS a1, 13*n**2/48-3*n**3/5+557*n**4/1440 AS a2, 61*n**3/240-103*n**4/140 AS a3, 49561*n**4/161280 AS a4 FROM c),
m AS (SELECT event_id, lat, zone, 500000 + r*(eta+a1*cos(2*xi)*sinh(2*eta)+a2*cos(4*xi)*sinh(4*eta)+a3*cos(6*xi)*sinh(6*eta)+a4*cos(8*xi)*sinh(8*eta)) AS e,
 CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + r*(xi+a1*sin(2*xi)*cosh(2*eta)+a2*sin(4*xi)*cosh(4*eta)+a3*sin(6*xi)*cosh(6*eta)+a4*sin(8*xi)*cosh(8*eta)) AS y FROM q)
SELECT event_id, lpad(CAST(zone AS VARCHAR), 2, '0') || substr('CDEFGHJKLMNPQRSTUVWX', least(CAST(floor((lat+80)/8) AS INT), 19) + 1, 1) || substr('ABCDEFGHJKLMNPQRSTUVWXYZ', (zone-1) % 3 * 8 + CAST(floor(e/100000) AS INT), 1)
 || substr('ABCDEFGHJKLMNPQRSTUV', (CAST(floor(y/100000) AS INT) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1, 1) || lpad(CAST(CAST(floor(e) AS BIGINT) % 100000 // 1000 AS VARCHAR), 2, '0') || lpad(CAST(CAST(floor(y) AS BIGINT) % 100000 // 1000 AS VARCHAR), 2, '0') AS mgrs FROM m""")
def mgrs_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square of one kilometre of every event."""
    return spread(spark, sf_dir).select("event_id", grids.mgrs("lat", "lon", 2).alias("mgrs"))


@query(f"""WITH {SPREAD}, {_geohash_sql(2)}, w AS (SELECT cell, count(*) AS n, avg(lat) AS y, epoch(date_trunc('hour', ts)) AS start_s FROM h GROUP BY cell, start_s)
SELECT CAST(start_s AS BIGINT) AS start_s, cell, n, round(y, 6) + 0.0::DOUBLE AS mean_lat FROM w WHERE start_s + 3600 <= (SELECT epoch_us(max(ts)) / 1000000.0 FROM events) - 3600""")
def stream_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream and counted by hour and cell; hours the watermark has not passed are still open."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e, u = F.col("event_id"), F.col("user_id")
    fixes = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"),
        _d((e * 7919 + u * 104729) % 1600001, 10000, 80).alias("lat"), _d((e * 15485863 + u * 32452843) % 3600001, 10000, 180).alias("lon"),
    )
    counts = arrived(windowed_cells(fixes, 2))
    start = F.unix_micros(F.col("start").cast("timestamp_ntz").cast("timestamp")) / 1000000
    return counts.select(start.cast("bigint").alias("start_s"), "cell", "n", _r(F.col("mean_lat"), 6).alias("mean_lat"))


@query(f"""WITH {SPREAD} SELECT event_id, round(lat, 6) + 0.0::DOUBLE AS lat, round(lon, 6) + 0.0::DOUBLE AS lon,
 CASE WHEN event_id % 3 <> 0 THEN 1.0::DOUBLE WHEN abs(lon) > 90 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM spread""")
def text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event written as decimal degrees, degrees and minutes by letters or degrees and seconds, in turn, and read again."""
    turn = F.col("event_id") % 3
    written = (
        F.when(turn == 0, text.format_dd("lat", "lon", 7)).when(turn == 1, text.format_ddm("lat", "lon", 6, "letters")).otherwise(text.format_dms("lat", "lon", 5))
    )
    p = spread(spark, sf_dir).select("event_id", parse_text(written).alias("p"))
    return p.select("event_id", _r(F.col("p.lat"), 6).alias("lat"), _r(F.col("p.lon"), 6).alias("lon"), "p.confidence")


from geoloom.plans import exchange, measures, pins  # noqa: E402, F401
