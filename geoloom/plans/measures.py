"""Queries of geodesics, rhumb lines, frames, datums, boxes and grid codes read back.

Where an operator has no short SQL, its inverse is run on its result and the SQL gives what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import china, codes, core, geodesic, geodesy, grids, mercator, privacy, rhumb, text
from geoloom.plans.queries import CHINA, SPREAD, _ECEF, _geohash_sql, _r, in_china, query, spread

#: A bearing and a distance for every event, off the values where a line is a meridian.
_WAY = "CAST(event_id*37 % 3599 AS DOUBLE)/10 + 0.05 AS bearing, CAST(event_id % 4999 AS DOUBLE)*100 + 1000 AS meters"


def _with_way(p: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return p.withColumn("bearing", (e * 37 % 3599).cast("double") / 10 + 0.05).withColumn("meters", (e % 4999).cast("double") * 100 + 1000)


@query(f"WITH {SPREAD}, w AS (SELECT *, {_WAY} FROM spread) SELECT event_id, round(meters, 4) AS distance_m, round(bearing, 6) AS initial_deg, round(meters/2, 4) AS half_m, round(meters*0.25, 4) AS quarter_m, round(meters, 4) AS farthest_m FROM w")
def geodesic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every event along a bearing, and the way there measured again: whole, to its middle and to a quarter."""
    p = _with_way(spread(spark, sf_dir)).withColumn("d", geodesic.destination("lat", "lon", "bearing", "meters"))
    p = p.withColumn("i", geodesic.inverse("lat", "lon", "d.lat", "d.lon"))
    p = p.withColumn("m", geodesic.midpoint("lat", "lon", "d.lat", "d.lon")).withColumn("q", geodesic.intermediate("lat", "lon", "d.lat", "d.lon", 0.25))
    ends = F.array(*[F.struct(F.col(f"{k}.lat").alias("lat"), F.col(f"{k}.lon").alias("lon")) for k in "mqd"])
    return p.select(
        "event_id", _r(F.col("i.distance_m"), 4).alias("distance_m"), _r(F.col("i.initial_deg"), 6).alias("initial_deg"),
        _r(geodesic.geodesic_distance("lat", "lon", "m.lat", "m.lon"), 4).alias("half_m"), _r(geodesic.geodesic_distance("lat", "lon", "q.lat", "q.lon"), 4).alias("quarter_m"),
        _r(geodesic.farthest("lat", "lon", ends), 4).alias("farthest_m"),
    )


@query(f"WITH {SPREAD}, w AS (SELECT *, {_WAY} FROM spread) SELECT event_id, round(bearing, 6) AS back_deg, round(lat, 7) + 0.0::DOUBLE AS lat FROM w")
def geodesic_final_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from the far end against the final bearing: the start, and its own bearing as the final one turned round."""
    p = _with_way(spread(spark, sf_dir)).withColumn("d", geodesic.destination("lat", "lon", "bearing", "meters"))
    p = p.withColumn("i", geodesic.inverse("lat", "lon", "d.lat", "d.lon"))
    p = p.withColumn("b", geodesic.destination("d.lat", "d.lon", core.normalize_degrees(F.col("i.final_deg") + 180.0), "meters"))
    p = p.withColumn("j", geodesic.inverse("d.lat", "d.lon", "b.lat", "b.lon"))
    return p.select("event_id", _r(core.normalize_degrees(F.col("j.final_deg") + 180.0), 6).alias("back_deg"), _r(F.col("b.lat"), 7).alias("lat"))


@query(f"""WITH {SPREAD}, w AS (SELECT *, {_WAY} FROM spread) SELECT event_id, round((CAST(event_id % 2001 AS DOUBLE) - 1000)*1500 + 0.5, 3) AS cross_m, round(meters, 3) AS along_m FROM w""")
def geodesic_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points set beside a path of 400 km at known places, found again."""
    p = _with_way(spread(spark, sf_dir)).withColumn("side", ((F.col("event_id") % 2001).cast("double") - 1000) * 1500 + 0.5)
    p = p.withColumn("e", geodesic.destination("lat", "lon", "bearing", 400_000.0)).withColumn("f", geodesic.destination("lat", "lon", "bearing", "meters"))
    p = p.withColumn("i", geodesic.inverse("f.lat", "f.lon", "lat", "lon"))
    ahead = F.col("i.initial_deg") + 180.0
    p = p.withColumn("x", geodesic.destination("f.lat", "f.lon", F.when(F.col("side") > 0, ahead + 90.0).otherwise(ahead - 90.0), F.abs("side")))
    path = ("x.lat", "x.lon", "lat", "lon", "e.lat", "e.lon")
    p = p.withColumn("k", geodesic.track_offset(*path))
    return p.select("event_id", _r(F.col("k.cross_m"), 3).alias("cross_m"), _r(F.col("k.along_m"), 3).alias("along_m"))


@query(f"""WITH {SPREAD}, w AS (SELECT *, {_WAY} FROM spread) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NoForwardCrossing' WHEN event_id % 5 = 1 THEN 'SameGeodesic' ELSE 'Crossing' END AS kind,
 CASE WHEN event_id % 5 > 1 THEN round(lat, 6) + 0.0::DOUBLE END AS lat, CASE WHEN event_id % 5 > 1 THEN round(CASE WHEN lon = 180 THEN -180 ELSE lon END, 6) + 0.0::DOUBLE END AS lon FROM w""")
def geodesic_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paths that were led through the event; in turn the first heads away from it, or both lie on one line."""
    turn = F.col("event_id") % 5
    p = _with_way(spread(spark, sf_dir)).withColumn("other", F.when(turn == 1, F.col("bearing")).otherwise(F.col("bearing") + 20.0 + (F.col("event_id") % 141).cast("double")))
    p = p.withColumn("a", geodesic.destination("lat", "lon", "bearing", "meters")).withColumn("b", geodesic.destination("lat", "lon", "other", F.col("meters") * 1.5 + 500.0))
    p = p.withColumn("i", geodesic.inverse("a.lat", "a.lon", "lat", "lon")).withColumn("j", geodesic.inverse("b.lat", "b.lon", "lat", "lon"))
    away = F.when(turn == 0, 180.0).otherwise(0.0)
    p = p.withColumn("x", geodesic.intersection("a.lat", "a.lon", F.col("i.initial_deg") + away, "b.lat", "b.lon", "j.initial_deg"))
    return p.select("event_id", "x.kind", _r(F.col("x.lat"), 6).alias("lat"), _r(core.wrap_longitude(F.col("x.lon")), 6).alias("lon"))


@query(f"WITH {SPREAD}, w AS (SELECT *, {_WAY} FROM spread) SELECT event_id, round(meters, 3) AS distance_m, round(bearing, 5) AS bearing_deg FROM w")
def rhumb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _with_way(spread(spark, sf_dir)).withColumn("d", rhumb.rhumb_destination("lat", "lon", "bearing", "meters"))
    return p.select("event_id", _r(rhumb.rhumb_distance("lat", "lon", "d.lat", "d.lon"), 3).alias("distance_m"), _r(rhumb.rhumb_bearing("lat", "lon", "d.lat", "d.lon"), 5).alias("bearing_deg"))


_PSI = "(atanh(sin(radians({0}))) - sqrt(e2)*atanh(sqrt(e2)*sin(radians({0}))))"


@query(f"""WITH {SPREAD}, e AS (SELECT *, lat*0.5 + 3 AS lat2, (1/298.257223563::DOUBLE)*(2 - 1/298.257223563::DOUBLE) AS e2 FROM spread), d AS (SELECT event_id, radians(25.0::DOUBLE) AS dl, {_PSI.format('lat2')} - {_PSI.format('lat')} AS dp FROM e)
SELECT event_id, round(CASE WHEN atan2(dl, dp) < 0 THEN degrees(atan2(dl, dp)) + 360 ELSE degrees(atan2(dl, dp)) END, 6) AS bearing_deg FROM d""")
def rhumb_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = core.wrap_longitude(F.col("lon") + 25.0)
    return spread(spark, sf_dir).select("event_id", _r(rhumb.rhumb_bearing("lat", "lon", F.col("lat") * 0.5 + 3, lon), 6).alias("bearing_deg"))


@query(f"WITH {SPREAD} SELECT event_id, round(lat, 8) + 0.0::DOUBLE AS lat, round(CASE WHEN lon = 180 THEN -180 ELSE lon END, 8) + 0.0::DOUBLE AS lon, CAST(event_id % 9000 AS DOUBLE) AS height_m, TRUE AS same FROM spread")
def frames_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions seen from a place as east-north-up, north-east-down and azimuth-elevation-range, and back from each."""
    p = spread(spark, sf_dir).withColumn("h", (F.col("event_id") % 9000).cast("double"))
    at, origin = ("lat", "lon", "h"), (47.0, 8.0, 400.0)
    p = p.withColumn("n", geodesy.to_ned(*at, *origin)).withColumn("a", geodesy.to_aer(*at, *origin)).withColumn("u", geodesy.to_enu(*at, *origin))
    p = p.withColumn("x", geodesy.from_ned(F.col("n"), *origin)).withColumn("y", geodesy.from_aer(F.col("a"), *origin)).withColumn("z", geodesy.from_enu(F.col("u"), *origin))
    p = p.withColumn("na", geodesy.ned_to_aer(F.col("n"))).withColumn("an", geodesy.aer_to_ned(F.col("a")))
    near = lambda a, b, d: F.abs(F.col(a) - F.col(b)) < d
    same = near("na.azimuth_deg", "a.azimuth_deg", 1e-9) & near("na.range_m", "a.range_m", 1e-6) & near("an.north_m", "n.north_m", 1e-5) & near("an.down_m", "n.down_m", 1e-5)
    same = same & near("y.lat", "x.lat", 1e-9) & near("z.lat", "x.lat", 1e-9) & near("y.height_m", "x.height_m", 1e-4) & geodesy.ecef("h", "lat", "lon").isNotNull()
    return p.select("event_id", _r(F.col("x.lat"), 8).alias("lat"), _r(F.col("x.lon"), 8).alias("lon"), _r(F.col("x.height_m"), 3).alias("height_m"), same.alias("same"))


@query(f"WITH {SPREAD}, {_ECEF}, o AS (SELECT radians(47.0::DOUBLE) AS p0, radians(8.0::DOUBLE) AS l0, 6378137.0/sqrt(1 - ((1/298.257223563::DOUBLE)*(2 - 1/298.257223563::DOUBLE))*power(sin(radians(47.0::DOUBLE)),2)) AS n0), d AS (SELECT event_id, p0, l0, x - (n0+400)*cos(p0)*cos(l0) AS dx, y - (n0+400)*cos(p0)*sin(l0) AS dy, z - (n0*(1-e2)+400)*sin(p0) AS dz FROM x, o) SELECT event_id, round(-sin(p0)*cos(l0)*dx - sin(p0)*sin(l0)*dy + cos(p0)*dz, 3)+0.0::DOUBLE AS north_m, round(-sin(l0)*dx + cos(l0)*dy, 3)+0.0::DOUBLE AS east_m, round(-(cos(p0)*cos(l0)*dx + cos(p0)*sin(l0)*dy + sin(p0)*dz), 3)+0.0::DOUBLE AS down_m FROM d")
def ned_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("h", (F.col("event_id") % 9000).cast("double")).withColumn("n", geodesy.to_ned("lat", "lon", "h", 47.0, 8.0, 400.0))
    return p.select("event_id", *[_r(F.col(f"n.{k}"), 3).alias(k) for k in ("north_m", "east_m", "down_m")])


def _shift_sql(a: str, f: str, dx: int, dy: int, dz: int) -> str:
    """Positions of an ellipsoid shifted to WGS-84 in SQL: to the centre, moved, and back by ten turns of the plain iteration."""
    e2 = f"(1/{f}::DOUBLE)*(2 - 1/{f}::DOUBLE)"
    w2 = "(1/298.257223563::DOUBLE)*(2 - 1/298.257223563::DOUBLE)"
    steps = "t0 AS (SELECT *, z/(r*(1-w2)) AS t FROM m)"
    for k in range(1, 11):
        steps += f", t{k} AS (SELECT * EXCLUDE (t), (z + w2*6378137.0/sqrt(1-w2*t*t/(1+t*t))*t/sqrt(1+t*t))/r AS t FROM t{k - 1})"
    return (
        f"n AS (SELECT *, {a}/sqrt(1 - {e2}*sin(radians(lat))*sin(radians(lat))) AS nn FROM spread), "
        f"c AS (SELECT event_id, nn*cos(radians(lat))*cos(radians(lon)) + {dx} AS x, nn*cos(radians(lat))*sin(radians(lon)) + {dy} AS y, nn*(1-{e2})*sin(radians(lat)) + {dz} AS z FROM n), "
        f"m AS (SELECT *, sqrt(x*x+y*y) AS r, {w2} AS w2 FROM c), {steps}"
    )


@query(f"WITH {SPREAD}, {_shift_sql('6377397.155', '299.1528128', -148, 507, 685)} SELECT event_id, round(degrees(atan(t)), 7) + 0.0::DOUBLE AS lat, round(degrees(atan2(y, x)), 7) + 0.0::DOUBLE AS lon FROM t10")
def tokyo_to_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("w", geodesy.DatumTransform.to_wgs84(core.TOKYO).apply("lat", "lon"))
    return p.select("event_id", _r(F.col("w.lat"), 7).alias("lat"), _r(F.col("w.lon"), 7).alias("lon"))


@query(f"WITH {SPREAD}, {_shift_sql('6378206.4', '294.9786982', -8, 160, 176)} SELECT event_id, round(degrees(atan(t)), 7) + 0.0::DOUBLE AS lat, round(degrees(atan2(y, x)), 7) + 0.0::DOUBLE AS lon, 0.0::DOUBLE AS max_error_m FROM t10")
def nad27_to_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispatcher between reference systems, from NAD27."""
    p = spread(spark, sf_dir).withColumn("w", china.to_crs(core.coordinate("lat", "lon", core.NAD27), core.WGS84))
    return p.select("event_id", _r(F.col("w.lat"), 7).alias("lat"), _r(F.col("w.lon"), 7).alias("lon"), "w.max_error_m")


@query(f"WITH {CHINA} SELECT event_id, round(lat, 6) AS gcj_lat, round(lon, 6) AS gcj_lon, round(lat, 6) AS wgs_lat, round(lon, 6) AS wgs_lon, 0.5::DOUBLE AS gcj_m, 1.0::DOUBLE AS wgs_m, TRUE AS tapped FROM china")
def bd09_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refined inverses of both forward maps give back the positions; a tap on what is displayed as well."""
    p = in_china(spark, sf_dir).withColumn("b", china.gcj02_to_bd09("lat", "lon")).withColumn("g", china.bd09_to_gcj02_refined("b.lat", "b.lon"))
    p = p.withColumn("c", china.wgs84_to_bd09("lat", "lon")).withColumn("w", china.to_crs(core.coordinate("c.lat", "c.lon", core.BD09), core.WGS84))
    p = p.withColumn("s", china.display_coordinate("lat", "lon")).withColumn("t", china.tap_to_wgs84("s.lat", "s.lon"))
    tapped = (F.abs(F.col("t.lat") - F.col("lat")) < 1e-7) & (F.abs(F.col("t.lon") - F.col("lon")) < 1e-7)
    return p.select(
        "event_id", _r(F.col("g.lat"), 6).alias("gcj_lat"), _r(F.col("g.lon"), 6).alias("gcj_lon"), _r(F.col("w.lat"), 6).alias("wgs_lat"), _r(F.col("w.lon"), 6).alias("wgs_lon"),
        F.col("g.max_error_m").alias("gcj_m"), F.col("w.max_error_m").alias("wgs_m"), tapped.alias("tapped"),
    )


def _baidu_sql() -> str:
    row = lambda r: f"[{', '.join(f'{v!r}::DOUBLE' for v in r)}]"
    bands = " ".join(f"WHEN lat >= {edge} THEN {row(r)}" for edge, r in zip(china.LATITUDES, china.TO_METERS))
    powers = " + ".join(f"f[{k + 3}]*power(lat/f[10], {k})" for k in range(7))
    return f"b AS (SELECT *, CASE {bands} ELSE {row(china.TO_METERS[-1])} END AS f FROM china), q AS (SELECT *, f[1] + f[2]*lon AS x, {powers} AS y FROM b)"


@query(f"WITH {CHINA}, {_baidu_sql()} SELECT event_id, round(x, 3) AS x_m, round(y, 3) AS y_m, round(lat, 4) AS lat, round(lon, 4) AS lon FROM q")
def baidu_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baidu's metres of BD-09 positions, and back to within its fits' drift."""
    p = in_china(spark, sf_dir).withColumn("m", china.coordinate_to_baidu(core.bd09("lat", "lon"))).withColumn("g", china.baidu_to_coordinate(F.col("m")))
    close = lambda k: F.when(F.abs(F.col(f"g.{k}") - F.col(k)) < 5e-6, F.col(k))
    return p.select("event_id", _r(F.col("m.x_m"), 3).alias("x_m"), _r(F.col("m.y_m"), 3).alias("y_m"), _r(close("lat"), 4).alias("lat"), _r(close("lon"), 4).alias("lon"))


@query(f"""WITH {SPREAD}, b AS (SELECT event_id, lat AS s1, least(lat + 5, 90) AS n1, lon AS w1, 20.0 AS p1, -lat AS s2, least(-lat + 3, 90) AS n2, CASE WHEN lon >= 90 THEN lon - 270 ELSE lon + 90 END AS w2, 10.0 AS p2 FROM spread),
g AS (SELECT *, w2 - w1 - 360*floor((w2 - w1)/360) AS ahead, w1 - w2 - 360*floor((w1 - w2)/360) AS back FROM b), r AS (SELECT *, greatest(p1, ahead + p2) AS a, greatest(p2, back + p1) AS c FROM g),
o AS (SELECT event_id, least(s1, s2) AS south, greatest(n1, n2) AS north, CASE WHEN a <= c THEN w1 ELSE w2 END AS west, CASE WHEN a <= c THEN w1 + a ELSE w2 + c END AS east FROM r)
SELECT event_id, round(south, 6) + 0.0::DOUBLE AS south, round(west, 6) + 0.0::DOUBLE AS west, round(north, 6) + 0.0::DOUBLE AS north, round(east - 360*floor((east + 180)/360), 6) + 0.0::DOUBLE AS east FROM o""")
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir)
    west2 = F.when(F.col("lon") >= 90, F.col("lon") - 270.0).otherwise(F.col("lon") + 90.0)
    a = geodesy.box("lat", "lon", F.least(F.col("lat") + 5, F.lit(90.0)), core.wrap_longitude(F.col("lon") + 20.0))
    b = geodesy.box(-F.col("lat"), west2, F.least(-F.col("lat") + 3, F.lit(90.0)), core.wrap_longitude(west2 + 10.0))
    p = p.withColumn("a", a).withColumn("b", b).withColumn("u", geodesy.box_union(F.col("a"), F.col("b")))
    return p.select("event_id", _r(F.col("u.south"), 6).alias("south"), _r(F.col("u.west"), 6).alias("west"), _r(F.col("u.north"), 6).alias("north"), _r(core.wrap_longitude(F.col("u.east")), 6).alias("east"))


@query(f"WITH {SPREAD} SELECT event_id, TRUE AS inside, TRUE AS tight FROM spread")
def box_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown by a distance hold the points at that distance from their corners, and hardly any farther ones."""
    p = _with_way(spread(spark, sf_dir)).withColumn("b", geodesy.box("lat", "lon", F.least(F.col("lat") + 1.0, F.lit(90.0)), core.wrap_longitude(F.col("lon") + 1.0)))
    p = p.withColumn("g", geodesic.box_expand(F.col("b"), "meters")).withColumn("d", geodesic.destination("lat", "lon", "bearing", "meters"))
    far = geodesic.geodesic_distance("lat", "lon", "g.south", "lon")
    tight = (far <= F.col("meters") + 0.01) | (F.col("g.south") == -90.0)
    return p.select("event_id", geodesy.box_contains(F.col("g"), "d.lat", "d.lon").alias("inside"), tight.alias("tight"))


def _middle(span_lat: str, span_lon: str) -> str:
    return f"round(floor((lat+90)/({span_lat}))*({span_lat}) + ({span_lat})/2 - 90, 7) + 0.0::DOUBLE AS lat, round(floor((lon+180)/({span_lon}))*({span_lon}) + ({span_lon})/2 - 180, 7) + 0.0::DOUBLE AS lon"


@query(f"""WITH {SPREAD}, {_geohash_sql(6)} SELECT event_id, upper(cell) AS shown, cell, round((gy + 0.5)*180/32768 - 90, 7) + 0.0::DOUBLE AS lat, round((gx + 0.5)*360/32768 - 180, 7) + 0.0::DOUBLE AS lon, TRUE AS bounded FROM h""")
def geohash_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells read from capitals with blanks around: canonical code, middle and a circumradius near the sphere's."""
    p = spread(spark, sf_dir).withColumn("shown", F.upper(grids.geohash("lat", "lon", 6)))
    raw = F.concat(F.lit("  "), F.col("shown"), F.lit(" "))
    p = p.withColumn("cell", codes.parse_geohash(raw)).withColumn("d", codes.geohash_decode(raw))
    sphere = geodesy.haversine("d.lat", 0.0, F.col("d.lat") + F.when(F.col("d.lat") >= 0, -1).otherwise(1) * (90.0 / 32768), 180.0 / 32768)
    near = F.abs(F.col("d.max_error_m") / sphere - 1.0) < 0.006
    return p.select("event_id", "shown", "cell", _r(F.col("d.lat"), 7).alias("lat"), _r(F.col("d.lon"), 7).alias("lon"), near.alias("bounded"))


@query(f"""WITH {SPREAD}, s AS (SELECT event_id, lat, CASE WHEN lon = 180 THEN -180 ELSE lon END AS lon FROM spread) SELECT event_id, {_middle('1.0::DOUBLE/24', '1.0::DOUBLE/12')} FROM s""")
def maidenhead_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("d", codes.maidenhead_decode(F.lower(grids.maidenhead("lat", "lon", 3))))
    back = codes.parse_maidenhead(F.lower(grids.maidenhead("d.lat", "d.lon", 3))) == grids.maidenhead("lat", "lon", 3)
    return p.select("event_id", F.when(back, _r(F.col("d.lat"), 7)).alias("lat"), F.when(back, _r(F.col("d.lon"), 7)).alias("lon"))


@query(f"""WITH {SPREAD}, v AS (SELECT event_id, CAST(floor(lat*25000000) AS BIGINT) + 2250000000 AS y, (CAST(floor((CASE WHEN lon = 180 THEN -180 ELSE lon END)*8192000) AS BIGINT) + 1474560000) % 2949120000 AS x FROM spread)
SELECT event_id, round(((y // 625)*625 + 312.5)/25000000 - 90, 8) + 0.0::DOUBLE AS lat, round(((x // 256)*256 + 128)/8192000.0 - 180, 9) + 0.0::DOUBLE AS lon, round((y // 25000000) + 0.5 - 90, 6) + 0.0::DOUBLE AS wide_lat FROM v""")
def plus_code_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 11 digits, and padded ones of 4 in small letters."""
    p = spread(spark, sf_dir).withColumn("d", codes.plus_code_decode(grids.plus_code("lat", "lon", 11))).withColumn("w", codes.plus_code_decode(F.lower(grids.plus_code("lat", "lon", 4))))
    return p.select("event_id", _r(F.col("d.lat"), 8).alias("lat"), _r(F.col("d.lon"), 9).alias("lon"), _r(F.col("w.lat"), 6).alias("wide_lat"))


@query(f"WITH {SPREAD} SELECT event_id, round(lat, 7) + 0.0::DOUBLE AS lat, round(CASE WHEN lon = 180 THEN -180 ELSE lon END, 7) + 0.0::DOUBLE AS lon, TRUE AS same FROM spread")
def utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir).withColumn("u", grids.utm("lat", "lon")).withColumn("g", grids.utm_inverse(F.col("u")))
    p = p.withColumn("r", codes.utm_reference("u.zone", F.col("u.hemi"), "u.easting_m", "u.northing_m"))
    far = codes.utm_reference(F.col("u.zone") % 60 + 1, F.col("u.hemi"), "u.easting_m", F.lit(1.0e7 + 1))
    return p.select("event_id", _r(F.col("g.lat"), 7).alias("lat"), core.wrap_longitude(_r(F.col("g.lon"), 7)).alias("lon"), ((F.col("r.easting_m") == F.col("u.easting_m")) & far.isNull()).alias("same"))


@query("""WITH polar AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 84 + CAST(event_id*7919 % 60001 AS DOUBLE)/10000 ELSE -80.0001 - CAST(event_id*7919 % 99999 AS DOUBLE)/10000 END AS lat, CAST(event_id*15485863 % 3600000 AS DOUBLE)/10000 - 180 AS lon FROM events),
k AS (SELECT *, (1/298.257223563::DOUBLE)*(2 - 1/298.257223563::DOUBLE) AS e2, abs(lat) AS a FROM polar),
r AS (SELECT *, 2*6378137.0*0.994/sqrt(power(1+sqrt(e2), 1+sqrt(e2))*power(1-sqrt(e2), 1-sqrt(e2)))*tan(radians(90-a)/2)*power((1+sqrt(e2)*sin(radians(a)))/(1-sqrt(e2)*sin(radians(a))), sqrt(e2)/2) AS rho FROM k)
SELECT event_id, CASE WHEN lat > 0 THEN 'N' ELSE 'S' END AS hemi, round(2000000 + rho*sin(radians(lon)), 3) AS easting_m, round(2000000 - sign(lat)*rho*cos(radians(lon)), 3) AS northing_m, round(lat, 8) AS lat, TRUE AS own, TRUE AS found FROM r""")
def ups_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polar positions in UPS and back, and as MGRS squares of 10 m that hold them."""
    e = F.col("event_id")
    lat = F.when(e % 2 == 0, (e * 7919 % 60001).cast("double") / 10000 + 84.0).otherwise(-80.0001 - (e * 7919 % 99999).cast("double") / 10000)
    p = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", lat.alias("lat"), ((e * 15485863 % 3600000).cast("double") / 10000 - 180.0).alias("lon"))
    p = p.withColumn("u", codes.ups("lat", "lon")).withColumn("g", codes.ups_inverse(F.col("u"))).withColumn("m", codes.mgrs_decode(grids.mgrs("lat", "lon", 4)))
    own = codes.ups_reference(F.col("u.hemi"), "u.easting_m", "u.northing_m").isNotNull()
    found = (geodesy.haversine("lat", "lon", "m.lat", "m.lon") <= F.col("m.max_error_m") * 1.01) & (F.col("m.code") == grids.mgrs("lat", "lon", 4))
    return p.select("event_id", "u.hemi", _r(F.col("u.easting_m"), 3).alias("easting_m"), _r(F.col("u.northing_m"), 3).alias("northing_m"), _r(F.col("g.lat"), 8).alias("lat"), own.alias("own"), found.alias("found"))


@query(f"WITH {SPREAD} SELECT event_id, TRUE AS near, TRUE AS same FROM spread")
def mgrs_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of 100 m read from small letters with blanks: the point lies within the bound, and the middle has the same reference."""
    code = F.col("code")
    shown = F.lower(F.concat(F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 2), F.lit(" "), F.substr(code, F.lit(6))))
    p = spread(spark, sf_dir).withColumn("code", grids.mgrs("lat", "lon", 3)).withColumn("shown", shown).withColumn("m", codes.mgrs_decode(F.col("shown")))
    near = geodesy.haversine("lat", "lon", "m.lat", "m.lon") <= F.col("m.max_error_m") * 1.01
    return p.select("event_id", near.alias("near"), ((grids.mgrs("m.lat", "m.lon", 3) == F.col("code")) & (codes.parse_mgrs(F.col("shown")) == F.col("code"))).alias("same"))


@query(f"WITH {SPREAD} SELECT event_id, 14 AS level, TRUE AS same, TRUE AS near, TRUE AS refused FROM spread")
def s2_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of every event's cell lies in that cell, and the event within the circumradius."""
    p = spread(spark, sf_dir).withColumn("cell", grids.s2_cell("lat", "lon", 14)).withColumn("d", codes.s2_decode(F.col("cell")))
    near = geodesy.haversine("lat", "lon", "d.lat", "d.lon") <= F.col("d.max_error_m") * 1.01
    refused = codes.s2_cell_id(F.shiftleft(F.col("cell"), 1)).isNull() & codes.s2_cell_id(F.lit(0).cast("bigint")).isNull()
    return p.select("event_id", grids.s2_level(F.col("cell")).cast("int").alias("level"), (grids.s2_cell("d.lat", "d.lon", 14) == F.col("cell")).alias("same"), near.alias("near"), refused.alias("refused"))


@query(f"""WITH {SPREAD}, s AS (SELECT event_id, lat, CASE WHEN lon = 180 THEN -180 ELSE lon END AS lon FROM spread), {_geohash_sql(5).replace('FROM spread', 'FROM s')}
SELECT event_id, round((gy + 0.5)*180/4096 - 90, 7) + 0.0::DOUBLE AS lat, round((gx + 0.5)*360/8192 - 180, 7) + 0.0::DOUBLE AS lon, 'privacy:geohash:' || cell AS source,
 CASE WHEN event_id % 2 = 0 THEN 'Bound' ELSE 'Unspecified' END AS kind, 4.5::DOUBLE AS own_m, TRUE AS in_s2 FROM h""")
def coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations moved to the middle of a geohash cell, their own error added to its radius; and to S2 cells."""
    five, twelve = privacy.Precision.at_least(4000.0), privacy.Precision.s2(12)
    p = spread(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 2 == 0, "Bound").otherwise("OneSigma"))
    p = p.withColumn("c", privacy.coarsen("lat", "lon", five)).withColumn("x", privacy.widened(F.col("c"), F.col("kind"), 4.5)).withColumn("s", privacy.coarsen("lat", "lon", twelve))
    return p.select(
        "event_id", _r(F.col("x.lat"), 7).alias("lat"), _r(F.col("x.lon"), 7).alias("lon"), "x.source", "x.kind", _r(F.col("x.horizontal_m") - F.col("c.max_error_m"), 6).alias("own_m"),
        F.startswith(F.col("s.source"), F.lit("privacy:s2:")).alias("in_s2"),
    )


@query(f"""WITH {SPREAD} SELECT event_id, lat + 0.0::DOUBLE AS lat, lon + 0.0::DOUBLE AS lon, 'GCJ-02' AS crs, CAST(event_id % 9000 AS DOUBLE) AS height_m, abs(lat) <= 0.000001 AND abs(lon) <= 0.000001 AS null_island, 2.5::DOUBLE AS error_m, CASE WHEN lat < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign,
 round(lat, 9) + 0.0::DOUBLE AS back, round(lon, 9) + 0.0::DOUBLE AS ddm_back, round(abs(lat)*3 + 7, 6) AS meters, epoch_us(ts) AS ts_us, 'Cep50' AS kind, TRUE AS refused FROM spread""")
def core_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates, heights, bounds, angles and observations made of every event's values, and refused out of range."""
    p = spread(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    point = core.with_height(core.gcj02("lat", "lon"), (F.col("event_id") % 9000).cast("double"), "orthometric")
    p = p.withColumn("f", core.fix(point, core.accuracy("Cep50", 3.0), F.col("ts"))).withColumn("d", core.dms_from_degrees("lat", "lat")).withColumn("m", core.ddm_from_degrees("lon", "lon"))
    d = core.dms("d.deg", "d.min", "d.sec", F.col("d.hemi"))
    refused = [
        core.coordinate(F.col("lat") + 200, "lon"), core.from_lon_lat(F.lit(float("nan")), "lat"), core.wgs84(91.0, "lon"), core.bd09("lat", 180.5), core.approx(F.col("lat"), -1.0), core.accuracy("Bound", -1.0),
        core.confidence(1.01), core.dms(10.0, 60.0, 0.0, F.lit("N")), core.with_height(point, F.lit(float("inf")), "ellipsoidal"),
    ]
    bad = F.forall(F.array(*[x.isNull() for x in refused]), lambda b: b)
    meters = core.from_unit(F.abs("lat"), "m") * 3 + core.from_unit(0.01, "km") - core.to_unit(3.0, "m")
    ends = core.ddm_to_dms(F.col("m"))
    return p.select(
        "event_id", "f.coord.lat", "f.coord.lon", "f.coord.crs", "f.coord.height_m", core.is_null_island("lat", "lon").alias("null_island"), core.approx(F.col("lat"), 2.5)["max_error_m"].alias("error_m"),
        core.hemisphere_sign(F.col("d.hemi")).alias("sign"), _r(core.dms_to_degrees(d), 9).alias("back"), _r(core.ddm_to_degrees(core.dms_to_ddm(ends)), 9).alias("ddm_back"), _r(meters, 6).alias("meters"),
        F.unix_micros("f.ts").alias("ts_us"), "f.accuracy.kind", bad.alias("refused"),
    )


@query(f"""WITH {SPREAD} SELECT event_id, round(lat, 7) + 0.0::DOUBLE AS lat, round(CASE WHEN lon = 180 THEN -180 ELSE lon END, 7) + 0.0::DOUBLE AS lon, round(lat, 6) + 0.0::DOUBLE AS pixel_lat, round((lon + 180)/360*512*32, 4) AS pixel_x,
 round(least(floor((lon+180)/360*128), 127)*360/128 - 180, 7) + 0.0::DOUBLE AS tile_west, TRUE AS inside, round(lat + 1, 6) + 0.0::DOUBLE AS mid_lat FROM spread""")
def map_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected metres and world pixels unprojected, and the bounds of the tile that holds each event."""
    p = spread(spark, sf_dir).withColumn("m", mercator.web_mercator("lat", "lon")).withColumn("x", mercator.world_pixel("lat", "lon", 5.0, 512.0)).withColumn("t", mercator.tile("lat", "lon", 7))
    p = p.withColumn("b", mercator.tile_bounds(F.col("t"))).withColumn("i", mercator.web_mercator_inverse("m.x_m", "m.y_m")).withColumn("w", mercator.world_pixel_inverse("x.x", "x.y", 5.0, 512.0))
    middle = geodesy.box_center(geodesy.box("lat", "lon", F.col("lat") + 2, core.wrap_longitude(F.col("lon") + 4)))
    inside = F.col("lat").between(F.col("b.south") - 1e-9, F.col("b.north") + 1e-9) & F.col("lon").between(F.col("b.west"), F.col("b.east"))
    return p.select(
        "event_id", _r(F.col("i.lat"), 7).alias("lat"), _r(F.col("i.lon"), 7).alias("lon"), _r(F.col("w.lat"), 6).alias("pixel_lat"), _r(F.col("x.x"), 4).alias("pixel_x"), _r(F.col("b.west"), 7).alias("tile_west"),
        inside.alias("inside"), _r(middle["lat"], 6).alias("mid_lat"),
    )


@query(f"""WITH {SPREAD}, w AS (SELECT *, {_WAY} FROM spread) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NoForwardCrossing' WHEN event_id % 5 = 1 THEN 'SameGreatCircle' ELSE 'Crossing' END AS kind, CASE WHEN event_id % 5 > 1 THEN round(lat, 6) + 0.0::DOUBLE END AS lat FROM w""")
def spherical_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two great circles led through the event on the sphere; in turn the first heads away from it, or both are one circle."""
    turn = F.col("event_id") % 5
    p = _with_way(spread(spark, sf_dir)).withColumn("other", F.when(turn == 1, F.col("bearing")).otherwise(F.col("bearing") + 20.0 + (F.col("event_id") % 141).cast("double")))

    def ahead(bearing: str, meters: Column) -> Column:
        """The point at a distance on the sphere, as STRUCT<lat, lon>."""
        d, t, q = meters / geodesy.SPHERE_M, F.radians(F.col(bearing)), F.radians(F.col("lat"))
        lat = F.asin(F.sin(q) * F.cos(d) + F.cos(q) * F.sin(d) * F.cos(t))
        lon = F.col("lon") + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(q), F.cos(d) - F.sin(q) * F.sin(lat)))
        return F.struct(F.degrees(lat).alias("lat"), core.wrap_longitude(lon).alias("lon"))

    p = p.withColumn("a", ahead("bearing", F.col("meters") + 50_000.0)).withColumn("b", ahead("other", F.col("meters") * 1.5 + 90_000.0))
    to = lambda k: geodesy.initial_bearing_spherical(f"{k}.lat", f"{k}.lon", "lat", "lon")
    p = p.withColumn("i", to("a") + F.when(turn == 0, 180.0).otherwise(0.0)).withColumn("j", to("b"))
    p = p.withColumn("x", geodesy.intersection_spherical("a.lat", "a.lon", "i", "b.lat", "b.lon", "j"))
    return p.select("event_id", "x.kind", _r(F.col("x.lat"), 6).alias("lat"))


@query(f"WITH {CHINA} SELECT event_id, TRUE AS composed, TRUE AS near, FALSE AS outside, TRUE AS formatted FROM china")
def china_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WGS-84 to BD-09 in one go equals both legs, the fast way back lies within its bound, and observations are written with the decimals they earn."""
    p = in_china(spark, sf_dir).withColumn("g", china.wgs84_to_gcj02("lat", "lon")).withColumn("b", china.wgs84_to_bd09("lat", "lon")).withColumn("c", china.gcj02_to_bd09("g.lat", "g.lon"))
    p = p.withColumn("w", china.bd09_to_wgs84_fast("b.lat", "b.lon"))
    near = geodesy.haversine("lat", "lon", "w.lat", "w.lon") <= F.col("w.max_error_m")
    outside = china.is_outside_china("lat", "lon") | china.is_outside_china("g.lat", "g.lon") & (F.col("lat") < 50) & (F.col("lon") < 130)
    shown = text.format_fix(core.fix(core.coordinate("lat", "lon"), core.accuracy("OneSigma", 1000.0)))
    formatted = (shown == text.format_dd("lat", "lon", 2)) & F.lit(text.separator_for_locale("de-AT") == ",")
    return p.select("event_id", ((F.col("b.lat") == F.col("c.lat")) & (F.col("b.lon") == F.col("c.lon"))).alias("composed"), near.alias("near"), outside.alias("outside"), formatted.alias("formatted"))
