"""Queries of documents, photo tags, gazetteers, layers, zones and clock offsets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import china, codes, core, geodesy, grids, mercator, privacy, text
from geoloom.operators import gazetteer, layers
from geoloom.operators.aggregates import cluster_record, summarize
from geoloom.operators.dbscan import dbscan
from geoloom.operators.tables import shared_root
from geoloom.operators.tracks import clean_track, estimate_offset, inside_boxes, points_with_cells, zone_circle, zones_apply
from geoloom.plans.queries import PLACES, SPREAD, TOWN, _geohash_sql, _hav, _places, _r, query, spread, town
from geoloom.sources import capture, detect, interchange, placefile


def _e() -> Column:
    return F.col("event_id")


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _positions(p: DataFrame, parsed: Column) -> DataFrame:
    p = p.withColumn("parsed", parsed)
    seen = p.select("event_id", "parsed.error_kind", F.posexplode_outer("parsed.positions").alias("nth", "q"))
    return seen.select(
        "event_id", "nth", _r(F.col("q.lat"), 9).alias("lat"), _r(F.col("q.lon"), 9).alias("lon"), "q.height_m", "q.height_kind", "q.horizontal_m",
        F.unix_micros("q.ts").alias("ts_us"), "error_kind",
    )


def _positions_sql(bad: str, error: str, second: str, height: str, surface: str, horizontal: str = "NULL::DOUBLE", ts: str = "NULL::BIGINT") -> str:
    """Rows of documents with a position at the event, with a height, and one at ``second``; those that are ``bad`` give only an error."""
    return f"""WITH {SPREAD} SELECT event_id, nth, CASE WHEN nth = 0 THEN round(lat, 9) + 0.0::DOUBLE ELSE round({second}, 9) + 0.0::DOUBLE END AS lat, CASE WHEN nth = 0 THEN round(lon, 9) + 0.0::DOUBLE ELSE round(-lon, 9) + 0.0::DOUBLE END AS lon,
 CASE WHEN nth = 0 THEN {height} END AS height_m, CASE WHEN nth = 0 THEN '{surface}' END AS height_kind, CASE WHEN nth = 1 THEN {horizontal} END AS horizontal_m, CASE WHEN nth = 1 THEN {ts} END AS ts_us, NULL AS error_kind
 FROM spread, (VALUES (0), (1)) AS v(nth) WHERE NOT ({bad}) UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{error}' FROM spread WHERE {bad}"""


_HEIGHT = "CAST(event_id % 900 AS DOUBLE) + 0.5"


@query(_positions_sql("event_id % 7 = 0", "Syntax", "lat/2", _HEIGHT, "ellipsoidal"))
def geojson_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a feature or a collection of geometries; one in seven has a position of one number."""
    p = spread(spark, sf_dir)
    one = F.concat(F.lit("["), _s("lon"), F.when(_e() % 7 != 0, F.concat(F.lit(","), _s("lat"), F.lit(","), (_e() % 900 + 0.5).cast("double").cast("string"))).otherwise(""), F.lit("]"))
    two = F.concat(F.lit("["), (-F.col("lon")).cast("string"), F.lit(","), (F.col("lat") / 2).cast("string"), F.lit("]"))
    line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":['), one, F.lit(", "), two, F.lit(']},"properties":{"a":[1,2]}}'))
    both = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":'), one, F.lit('},{"coordinates":[[['), two, F.lit(']]],"type":"MultiPolygon"}]}'))
    return _positions(p, interchange.parse_geojson(F.when(_e() % 2 == 0, line).otherwise(both)))


@query(_positions_sql("event_id % 7 = 0", "Syntax", "lat/2", _HEIGHT, "ellipsoidal"))
def wkt_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a collection or a line; one in seven lacks its last bracket."""
    high = (_e() % 900 + 0.5).cast("double").cast("string")
    one, two = F.concat_ws(" ", _s("lon"), _s("lat"), high), F.concat_ws(" ", (-F.col("lon")).cast("string"), (F.col("lat") / 2).cast("string"))
    whole = F.concat(F.lit("GEOMETRYCOLLECTION (POINT Z ("), one, F.lit("), point empty, MULTIPOLYGON ((("), two, F.lit("))))"))
    other = F.concat(F.lit("GeometryCollection(LINESTRING("), one, F.lit("), MULTIPOINT(("), two, F.lit(")))"))
    made = F.when(_e() % 2 == 0, whole).otherwise(other)
    return _positions(spread(spark, sf_dir), interchange.parse_wkt(F.when(_e() % 7 == 0, F.left(made, F.length(made) - 1)).otherwise(made)))


@query(_positions_sql("event_id % 7 = 0", "OutOfRange", "lat/2", _HEIGHT, "orthometric", "12.5::DOUBLE", "epoch_us(ts)"))
def gpx_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a waypoint, written after a track point with a time and a dilution; one in seven lies off the globe."""
    high = (_e() % 900 + 0.5).cast("double").cast("string")
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    track = F.concat(F.lit('<trk><trkseg><trkpt lat="'), (F.col("lat") / 2).cast("string"), F.lit('" lon="'), (-F.col("lon")).cast("string"), F.lit('"><time>'), when, F.lit("</time><hdop>2.5</hdop></trkpt></trkseg></trk>"))
    lat = F.when(_e() % 7 == 0, F.lit("91")).otherwise(_s("lat"))
    point = F.concat(F.lit('<wpt lat="'), lat, F.lit('" lon="'), _s("lon"), F.lit('"><ele>'), high, F.lit("</ele></wpt>"))
    return _positions(spread(spark, sf_dir), interchange.parse_gpx(F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1">'), track, point, F.lit("</gpx>"))))


@query(_positions_sql("event_id % 7 = 0", "Syntax", "lat/2", _HEIGHT, "orthometric"))
def kml_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a placemark in a folder, then a line; one in seven has a point without a position."""
    at = F.concat_ws(",", _s("lon"), _s("lat"), (_e() % 900 + 0.5).cast("double").cast("string"))
    point = F.concat(F.lit("<Placemark><Point><coordinates>"), F.when(_e() % 7 == 0, "").otherwise(at), F.lit("</coordinates></Point></Placemark>"))
    line = F.concat(F.lit("<Placemark><MultiGeometry><LineString><coordinates> "), F.concat_ws(",", (-F.col("lon")).cast("string"), (F.col("lat") / 2).cast("string")), F.lit("\n</coordinates></LineString></MultiGeometry></Placemark>"))
    return _positions(spread(spark, sf_dir), interchange.parse_kml(F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>'), point, F.lit("</Folder>"), line, F.lit("</Document></kml>"))))


_CAPTURED = f"""WITH {SPREAD} SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN round(lat, 6) + 0.0::DOUBLE END AS lat, CASE WHEN event_id % 11 <> 0 THEN round(lon, 6) + 0.0::DOUBLE END AS lon, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'Tokyo' ELSE 'WGS84' END END AS crs,
 CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 4 THEN (CASE WHEN event_id % 5 IN (1, 3) THEN -1 ELSE 1 END)*CAST(event_id % 900 AS DOUBLE)/10 + 0.0::DOUBLE END AS height_m, CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 4 THEN CASE WHEN event_id % 5 >= 2 THEN 'ellipsoidal' ELSE 'orthometric' END END AS height_kind,
 CASE WHEN event_id % 11 <> 0 THEN 36.0::DOUBLE/3.6 END AS speed_mps, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS aimed_deg, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END END AS confidence,
 CASE WHEN event_id % 11 <> 0 THEN event_id % 3 <> 0 AND lat BETWEEN 0.8293 AND 55.8271 AND lon BETWEEN 72.004 AND 137.8347 END AS possibly_gcj02, CASE WHEN event_id % 11 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS ts_us,
 CASE WHEN event_id % 11 <> 0 THEN (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) + (CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END) END AS n_notes, CASE WHEN event_id % 11 = 0 THEN 'NoFix' END AS error_kind FROM spread"""


def _captured(p: DataFrame, made: Column) -> DataFrame:
    p = p.withColumn("c", made)
    return p.select(
        "event_id", _r(F.col("c.lat"), 6).alias("lat"), _r(F.col("c.lon"), 6).alias("lon"), "c.crs", (F.col("c.height_m") + 0.0).alias("height_m"), "c.height_kind", F.col("c.speed_mps"),
        F.col("c.direction.degrees").alias("aimed_deg"), "c.confidence", "c.possibly_gcj02", F.unix_micros("c.ts").alias("ts_us"),
        F.when(F.col("c.notes").isNotNull(), F.size("c.notes")).alias("n_notes"), "c.error_kind",
    )


@query(_CAPTURED)
def exif_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a photo's tags: some without a position, some with a wrong altitude ref, some in another datum."""
    num = lambda x, den: F.struct(x.cast("bigint").alias("num"), F.lit(den).cast("bigint").alias("den"))

    def axis(name: str) -> Column:
        size = F.round(F.abs(F.col(name)) * 3.6e9).cast("bigint")
        return F.array(num(F.floor(size / 3_600_000_000), 1), num(F.floor(size / 60_000_000) % 60, 1), num(size % 60_000_000, 1_000_000))

    ts = F.col("ts").cast("timestamp")
    gps = F.struct(
        F.when(_e() % 11 != 0, axis("lat")).alias("latitude"), F.when(F.col("lat") < 0, "S").otherwise("n ").alias("latitude_ref"), axis("lon").alias("longitude"),
        F.when(F.col("lon") < 0, "W\0").otherwise("E").alias("longitude_ref"), num(_e() % 900, 10).alias("altitude"), F.when(_e() % 5 == 4, 9).otherwise(_e() % 5).cast("int").alias("altitude_ref"),
        F.when(_e() % 3 == 0, "TOKYO").alias("map_datum"), num(F.lit(36), 1).alias("speed"), F.lit("k").alias("speed_ref"), num(_e() % 360, 1).alias("img_direction"), F.lit("T").alias("img_direction_ref"),
        F.date_format(ts, "yyyy:MM:dd").alias("date_stamp"), F.array(*[num(f(ts), 1) for f in (F.hour, F.minute, F.second)]).alias("time_stamp"),
    )
    p = spread(spark, sf_dir).withColumn("gps", gps)
    return _captured(p, capture.from_exif(F.col("gps"), p.schema["gps"].dataType))


@query(_CAPTURED)
def xmp_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same photos by their XMP strings."""

    def axis(name: str, plus: str, minus: str) -> Column:
        size = F.abs(F.col(name))
        minutes = F.format_string("%.8f", F.round((size - F.floor(size)) * 60.0, 8))
        return F.concat(F.floor(size).cast("string"), F.lit(","), minutes, F.when(F.col(name) < 0, minus).otherwise(plus))

    ts = F.col("ts").cast("timestamp")
    gps = F.struct(
        F.when(_e() % 11 != 0, axis("lat", "N", "S")).alias("latitude"), axis("lon", "E", "W").alias("longitude"), F.concat((_e() % 900).cast("string"), F.lit("/10")).alias("altitude"),
        F.when(_e() % 5 == 4, "above").otherwise((_e() % 5).cast("string")).alias("altitude_ref"), F.when(_e() % 3 == 0, "Tokyo").alias("map_datum"), F.lit("36").alias("speed"), F.lit("K").alias("speed_ref"),
        (_e() % 360).cast("string").alias("img_direction"), F.lit("t").alias("img_direction_ref"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time_stamp"),
    )
    p = spread(spark, sf_dir).withColumn("gps", gps)
    return _captured(p, capture.from_xmp(F.col("gps"), p.schema["gps"].dataType))


_CODES = ["PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLX", "PPLH", "STLMT"]


def _geonames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The driver's suppliers and nations in the shape of GeoNames tables."""
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("s_suppkey").cast("bigint")
    country = F.concat(F.char(F.lit(65) + F.col("s_nationkey") % 26), F.lit("X"))
    fields = {
        0: k, 1: F.col("s_name"), 4: (k * 7919 % 1601).cast("double") / 10 - 80.0, 5: (k * 15485863 % 3601).cast("double") / 10 - 180.0, 6: F.when(k % 13 == 0, "H").otherwise("P"),
        7: F.get(F.array(*map(F.lit, _CODES)), (k % len(_CODES)).cast("int")), 8: country, 10: (F.col("s_nationkey") % 3).cast("string"), 11: F.lit("7"), 14: k * 1000 * (k % 4).cast("bigint"),
    }
    cities = s.select(*[fields[i].cast("string").alias(f"_c{i}") if i in fields else F.lit("").alias(f"_c{i}") for i in range(19)])
    area = F.concat(F.char(F.lit(65) + F.col("n_nationkey") % 26), F.lit("X."), (F.col("n_nationkey") % 3).cast("string"))
    admin1 = n.where("n_nationkey % 2 = 0").select(area.alias("_c0"), F.col("n_name").alias("_c1"))
    admin2 = n.where("n_nationkey % 5 = 0").select(F.concat(area, F.lit(".7")).alias("_c0"), F.concat(F.lit("two "), F.col("n_name")).alias("_c1"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(f"v{j}") for j, v in enumerate(x)]) for i, x in enumerate([("fr", "", ""), ("FR", "1", ""), ("ja", "", "1"), ("fr", "1", "1"), ("de", "1", "")])]))
    alternates = s.select(k.alias("k"), "s_name", kinds.alias("x")).select(
        (F.col("k") * 10 + F.col("x.i")).cast("string").alias("_c0"), _s("k").alias("_c1"), F.col("x.v0").alias("_c2"), F.concat(F.lit("alt "), _s("x.i"), F.lit(" "), F.col("s_name")).alias("_c3"),
        F.col("x.v1").alias("_c4"), F.col("x.v2").alias("_c5"), F.when(F.col("k") % 5 == 0, "1").otherwise("").alias("_c6"), F.lit("").alias("_c7"),
    )
    return cities, admin1, admin2, alternates


_GAZETTEER = f"""g AS (SELECT CAST(s_suppkey AS BIGINT) AS geoname_id, s_name AS name, CAST((CAST(s_suppkey AS BIGINT)*7919) % 1601 AS DOUBLE)/10 - 80 AS lat, CAST((CAST(s_suppkey AS BIGINT)*15485863) % 3601 AS DOUBLE)/10 - 180 AS lon, chr(CAST(65 + s_nationkey % 26 AS INT)) || 'X' AS country,
 CASE s_suppkey % 9 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 6 WHEN 6 THEN 0 ELSE 1 END AS class, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey AS BIGINT)*1000*(s_suppkey % 4) END AS population, s_nationkey FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 9 <> 7),
a AS (SELECT g.*, n.n_name AS admin1_name, m.n_name AS m_name FROM g LEFT JOIN nation n ON n.n_nationkey = g.s_nationkey AND n.n_nationkey % 2 = 0 LEFT JOIN nation m ON m.n_nationkey = g.s_nationkey AND m.n_nationkey % 5 = 0),
p AS (SELECT row_number() OVER (ORDER BY geoname_id) - 1 AS idx, *, CASE WHEN m_name IS NOT NULL THEN 'two ' || m_name END AS admin2_name, CASE WHEN geoname_id % 5 <> 0 THEN 'alt 1 ' || name END AS fr, CASE WHEN geoname_id % 5 <> 0 THEN 'alt 2 ' || name END AS ja FROM a)"""


@query(f"WITH {_GAZETTEER} SELECT idx, geoname_id, name, round(lat, 5) + 0.0::DOUBLE AS lat, round(lon, 5) + 0.0::DOUBLE AS lon, country, class, population, CASE WHEN admin1_name IS NOT NULL THEN CAST(s_nationkey % 3 AS VARCHAR) END AS admin1_code, admin1_name, admin2_name, fr, ja FROM p")
def gazetteer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer of GeoNames tables: classes, divisions and the best names in two languages."""
    p = gazetteer.from_geonames(*_geonames(spark, sf_dir), languages=["fr", "ja"])
    return p.select(
        "idx", "geoname_id", "name", _r(F.col("lat"), 5).alias("lat"), _r(F.col("lon"), 5).alias("lon"), "country", "class", "population", "admin1_code", "admin1_name", "admin2_name",
        gazetteer.localized_name(F.col("localized"), "FR").alias("fr"), gazetteer.localized_name(F.col("localized"), "ja").alias("ja"),
    )


@query(f"WITH {_GAZETTEER} SELECT idx, name, round(lat, 5) + 0.0::DOUBLE AS lat, round(lon, 5) + 0.0::DOUBLE AS lon, country, class, population, CASE WHEN admin1_name IS NOT NULL THEN CAST(s_nationkey % 3 AS VARCHAR) END AS admin1_code, admin1_name, admin2_name, fr, '2024-05-06' AS source_date FROM p")
def gazetteer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer written as binary files into the shared folder and read back; of two languages one is kept."""
    folder = f"{shared_root(spark)}/gaz-{uuid.uuid4().hex}"
    placefile.write_place_files(gazetteer.from_geonames(*_geonames(spark, sf_dir), languages=["fr", "ja"]), folder, "2024-05-06", "made of suppliers", ["fr"], 5000)
    p = placefile.open_place_files(spark, folder)
    return p.select(
        "idx", "name", _r(F.col("lat"), 5).alias("lat"), _r(F.col("lon"), 5).alias("lon"), "country", "class", "population", "admin1_code", "admin1_name", "admin2_name",
        gazetteer.localized_name(F.col("localized"), "fr").alias("fr"), "source_date",
    )


@query(f"""WITH {SPREAD}, {_GAZETTEER}, d AS (SELECT s.event_id AS qid, p.idx, {_hav('s.lat', 's.lon', 'p.lat', 'p.lon')} AS m FROM spread s JOIN p ON p.class >= 2 AND p.population >= 10000 AND {_hav('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 900000),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, idx) AS rn FROM d) SELECT s.event_id AS qid, p.name, p.country, p.admin1_name, coalesce(p.ja, p.name) AS shown, p.name IS NULL OR NOT isnan(r.m) AS placed FROM spread s LEFT JOIN r ON r.qid = s.event_id AND r.rn = 1 LEFT JOIN p ON p.idx = r.idx""")
def reverse_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest admissible place of every event with its division and its name in the first language there is."""
    places = gazetteer.from_geonames(*_geonames(spark, sf_dir), languages=["fr", "ja"])
    held = [("fr", "ja")[k] for k in gazetteer.language_positions(["fr", "ja"], ["ja-JP", "xx"])]
    q = spread(spark, sf_dir).select(F.col("event_id").alias("qid"), "lat", "lon")
    met = gazetteer.reverse(q, places, 900_000.0, 10_000, 2, held).join(q, "qid").join(places.select(F.col("idx").alias("place_idx"), F.col("lat").alias("plat"), F.col("lon").alias("plon")), "place_idx", "left")
    made = gazetteer.with_admin(gazetteer.place(F.col("name"), F.col("plat"), F.col("plon"), F.col("country"), F.col("lat"), F.col("lon")), 1, F.lit("0"), F.col("admin1_name"))
    met = met.withColumn("p", made)
    near = F.col("p").isNull() | (F.abs(F.col("p.distance_m") / F.col("distance_m") - 1.0) < 0.006)
    return met.select("qid", "name", "country", F.col("p.admin1_name").alias("admin1_name"), "shown", near.alias("placed"))


@query(f"""WITH {SPREAD}, {_geohash_sql(2)} SELECT cell, count(*) AS n, min(event_id) AS first_idx, sum(event_id) AS ids FROM h GROUP BY cell""")
def points_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of point features for each cell, read again: the features' count, the first one's id and the sum of ids."""
    from geoloom.functions.grids import geohash

    p = spread(spark, sf_dir).withColumnRenamed("event_id", "idx").withColumn("cell", geohash("lat", "lon", 2))
    f = layers.point_features(p).join(p.select("idx", "cell"), "idx")
    made = layers.collections(f, ["cell"], "idx")
    kind = "struct<type:string,features:array<struct<type:string,id:bigint,geometry:struct<type:string,coordinates:array<double>>,properties:struct<point_id:bigint>>>>"
    made = made.withColumn("d", F.from_json("geojson", kind))
    ids = F.aggregate(F.col("d.features"), F.lit(0).cast("bigint"), lambda a, x: a + x["properties"]["point_id"])
    return made.select("cell", F.size("d.features").cast("bigint").alias("n"), F.get("d.features", F.lit(0))["id"].alias("first_idx"), ids.cast("decimal(38,0)").alias("ids"))


@query(f"""WITH {SPREAD}, {_geohash_sql(4)}, c AS (SELECT cell, count(*) AS n, min(event_id) AS f FROM h GROUP BY cell) SELECT f AS id, CASE WHEN n > 1 THEN TRUE END AS cluster, CASE WHEN n > 1 THEN n*700 END AS point_count, CASE WHEN n > 1 THEN
 CASE WHEN n*700 < 1000 THEN CAST(n*700 AS VARCHAR) WHEN n*700 < 10000 THEN CAST(n*7 // 10 AS VARCHAR) || CASE WHEN n*7 % 10 = 0 THEN '' ELSE '.' || CAST(n*7 % 10 AS VARCHAR) END || 'k' ELSE CAST(CAST(floor(n*0.7 + 0.5) AS BIGINT) AS VARCHAR) || 'k' END END AS label FROM c""")
def clusters_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as cluster features, their counts as if each event stood for 700."""
    from geoloom.functions.grids import geohash

    p = spread(spark, sf_dir).groupBy(geohash("lat", "lon", 4).alias("cell")).agg(F.count("*").alias("c"), F.min("event_id").alias("cluster_id"), F.min(F.struct("event_id", "lat", "lon")).alias("m"))
    p = p.select("cluster_id", "m.lat", "m.lon", F.when(F.col("c") > 1, F.col("c") * 700).otherwise(1).cast("bigint").alias("n"), F.col("cluster_id").alias("first_idx"))
    d = layers.cluster_features(p).withColumn("d", F.from_json("feature", "struct<properties:struct<cluster:boolean,point_count:bigint,point_count_abbreviated:string,point_id:bigint>>"))
    return d.select(F.col("cluster_id").alias("id"), "d.properties.cluster", "d.properties.point_count", F.col("d.properties.point_count_abbreviated").alias("label"))


@query(f"""WITH {SPREAD}, {PLACES}, z AS (SELECT lat, lon, CAST(50000 * (1 + idx % 8) AS DOUBLE) AS radius FROM places), {_geohash_sql(4)}, i AS (SELECT DISTINCT s.event_id FROM spread s JOIN z ON {_hav('s.lat', 's.lon', 'z.lat', 'z.lon')} <= z.radius)
SELECT h.event_id, round(CASE WHEN i.event_id IS NULL THEN h.lat ELSE (gy + 0.5)*180/1024 - 90 END, 6) + 0.0::DOUBLE AS lat, CASE WHEN i.event_id IS NULL THEN 'OneSigma' ELSE 'Unspecified' END AS kind, CASE WHEN i.event_id IS NOT NULL THEN 'privacy:geohash:' || cell END AS source
 FROM h LEFT JOIN i ON i.event_id = h.event_id""".replace("FROM spread), h AS", "FROM (SELECT event_id, user_id, ts, event_type, lat, CASE WHEN lon = 180 THEN -180 ELSE lon END AS lon FROM spread)), h AS"))
def zones_coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside a zone moved to the middle of their cell, the others as they are."""
    zones = _places(spark, sf_dir).select(F.col("idx").alias("zone_id"), "lat", "lon", ((F.col("idx") % 8 + 1) * 50000.0).alias("radius_m"))
    p = spread(spark, sf_dir).withColumnRenamed("event_id", "idx").withColumn("kind", F.lit("OneSigma")).withColumn("horizontal_m", F.lit(5.0))
    z = zones_apply(p, zones, privacy.Precision.geohash(4))
    return z.select(F.col("idx").alias("event_id"), _r(F.col("lat"), 6).alias("lat"), "kind", "source")


@query(f"WITH {SPREAD}, u AS (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, ts FROM spread) GROUP BY user_id) SELECT user_id, least(n, 3) AS n, (user_id % 50 - 25)*1000 AS offset_ms FROM u")
def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three photos a user at places and times of the track, by a clock that is wrong by a known time."""
    fixes = spread(spark, sf_dir).groupBy("user_id", F.col("ts").cast("timestamp").alias("ts")).agg(F.min(F.struct("event_id", "lat", "lon")).alias("m")).select(F.col("user_id").alias("track_id"), "ts", "m.lat", "m.lon")
    late = ((F.col("track_id") % 50 - 25) * 1_000_000).cast("bigint")
    from pyspark.sql import Window as W

    photos = fixes.withColumn("nth", F.row_number().over(W.partitionBy("track_id").orderBy("ts"))).where("nth <= 3")
    photos = photos.select("track_id", F.timestamp_micros(F.unix_micros("ts") - late).alias("ts"), "lat", "lon")
    return estimate_offset(fixes, photos).select(F.col("track_id").alias("user_id"), "n", "offset_ms")


@query(f"""WITH RECURSIVE {TOWN}, e AS (SELECT a.event_id AS a, b.event_id AS b, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM town a JOIN town b ON abs(a.lat-b.lat) < 0.001 AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 25),
k AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4), g AS (SELECT e.a, e.b FROM e JOIN k x ON x.a = e.a JOIN k y ON y.a = e.b),
reach AS (SELECT a AS id, a AS r FROM k UNION SELECT g.b, reach.r FROM reach JOIN g ON g.a = reach.id AND g.b > reach.r), c AS (SELECT id, min(r) AS comp FROM reach GROUP BY id),
n AS (SELECT e.a AS id, arg_min(c.comp, (e.m, t.lat, t.lon)) AS comp FROM e JOIN c ON c.id = e.b JOIN town t ON t.event_id = e.b WHERE e.a NOT IN (SELECT id FROM c) GROUP BY e.a),
m AS (SELECT * FROM c UNION ALL SELECT * FROM n), f AS (SELECT comp, min(id) AS first_idx, count(*) AS n FROM m GROUP BY comp), b AS (SELECT m.comp, min(t.lat) AS south, max(t.lat) AS north FROM m JOIN town t ON t.event_id = m.id GROUP BY m.comp)
SELECT row_number() OVER (ORDER BY first_idx) - 1 AS cluster_id, n, first_idx, round(south, 7) + 0.0::DOUBLE AS south, round(north, 7) + 0.0::DOUBLE AS north, TRUE AS bounded, TRUE AS ascending FROM f JOIN b USING (comp)""")
def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, earliest member, box and centroid of each density cluster, numbered by earliest member; no member is beyond the bound."""
    p = town(spark, sf_dir).withColumnRenamed("event_id", "idx")
    d = dbscan(p, 25.0, 4).join(p.select("idx", "lat", "lon"), "idx")
    s = summarize(d, ["cluster_id"])
    far = d.where("cluster_id IS NOT NULL").join(s.select("cluster_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"), "max_error_m"), "cluster_id")
    far = far.groupBy("cluster_id").agg(F.max(geodesy.haversine("lat", "lon", "clat", "clon") / F.col("max_error_m")).alias("part"), F.sort_array(F.collect_list("idx")).alias("members"), F.first("clat").alias("clat"), F.first("clon").alias("clon"), F.first("max_error_m").alias("m"))
    rising = cluster_record(F.col("members"), F.col("clat"), F.col("clon"), F.col("m")).isNotNull() & cluster_record(F.reverse(F.concat("members", F.array(F.lit(-1).cast("bigint")))), F.col("clat"), F.col("clon"), F.col("m")).isNull()
    return s.join(far, "cluster_id").select("cluster_id", "n", "first_idx", _r(F.col("south"), 7).alias("south"), _r(F.col("north"), 7).alias("north"), ((F.col("part") <= 1.0) | (F.col("m") <= 1e-5)).alias("bounded"), rising.alias("ascending"))


@query(f"""WITH {SPREAD} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'geo_uri' WHEN 1 THEN 'plus_code' WHEN 2 THEN 'mgrs' ELSE 'text' END AS how, TRUE AS near, CASE WHEN event_id % 4 < 3 THEN 1.0::DOUBLE WHEN abs(lon) > 90 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM spread""")
def detected_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event written in one of four ways, and read without being told which."""
    turn = _e() % 4
    from geoloom.functions.grids import mgrs, plus_code

    written = F.when(turn == 0, F.concat(F.lit("geo:"), _s("lat"), F.lit(","), _s("lon"))).when(turn == 1, plus_code("lat", "lon", 11)).when(turn == 2, mgrs("lat", "lon", 5)).otherwise(text.format_dd("lat", "lon", 6))
    p = spread(spark, sf_dir).withColumn("written", written).withColumn("p", detect.parse_coordinate(F.col("written")))
    near = geodesy.haversine("lat", "lon", "p.lat", "p.lon") <= F.greatest(F.coalesce(F.col("p.max_error_m"), F.lit(0.0)), F.lit(0.3)) * 1.01
    return p.select("event_id", "p.how", near.alias("near"), "p.confidence")


@query(f"""WITH {SPREAD} SELECT event_id, TRUE AS kept, TRUE AS refused, floor(lon) = floor(lon) AS celled FROM spread""")
def checked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructors that check what they are given: each keeps the event's values and refuses them out of range."""
    p = spread(spark, sf_dir)
    big, hemi = F.lit(1e9), F.when(F.col("lat") < 0, "S").otherwise("N")
    size = F.abs(F.col("lat"))
    good = [
        core.ddm(F.floor(size), (size - F.floor(size)) * 60.0, hemi), core.datum_point(core.gcj02("lat", "lon"), core.GCJ02), core.raw_source(hemi, 0.5), core.crs_name(core.bd09("lat", "lon")),
        geodesy.ecef("lat", "lon", "lat"), geodesy.enu("lat", "lon", "lat"), geodesy.ned("lat", "lon", "lat"), geodesy.aer("lon", "lat", 5.0), mercator.camera("lat", "lon", 3.0), mercator.viewport(800.0, 600.0),
        mercator.mercator_point("lon", "lat"), mercator.tile_at(3, _e() % 8, 0.0), core.from_datum_point(core.datum_point(core.wgs84("lat", "lon"), core.WGS84), core.WGS84),
        core.height_length(core.with_height(core.wgs84("lat", "lon"), 3.0, "ellipsoidal")), core.approx_map(core.approx(F.col("lat"), 2.0), lambda v: v * 2.0)["max_error_m"], codes.h3_cell_id(F.lit(0x8928308280FFFFF).cast("bigint")),
        capture.north_bearing(F.abs(F.col("lon")), F.lit("m")), zone_circle(F.col("lat"), F.col("lon"), F.lit(10.0)),
    ]
    bad = [
        core.ddm(F.floor(size), F.lit(60.0), hemi), core.datum_point(core.gcj02("lat", "lon"), core.BD09), core.raw_source(hemi, 1.5), geodesy.ecef("lat", F.lit(float("nan")), "lat"), geodesy.aer("lon", 91.0, 5.0), geodesy.aer("lon", "lat", -5.0),
        mercator.camera("lat", "lon", 31.0), mercator.viewport(0.0, 600.0), mercator.mercator_point(big, "lat"), mercator.tile_at(3, 8.0, 0.0), codes.h3_cell_id(F.lit(0x8928308280FFFF0).cast("bigint")), codes.h3_cell_id(_e()), capture.north_bearing(F.lit(360.0), F.lit("T")),
        zone_circle(F.col("lat"), F.col("lon"), F.lit(-1.0)),
    ]
    all_ = lambda xs, f: F.forall(F.array(*[f(x) for x in xs]), lambda b: b)
    cells = points_with_cells(p, 400_000.0)
    return cells.select("event_id", all_(good, lambda x: x.isNotNull()).alias("kept"), all_(bad, lambda x: x.isNull()).alias("refused"), (F.abs("cx") + F.abs("cy") + F.abs("cz") >= 15).alias("celled"))


@query(f"""WITH {SPREAD}, {PLACES}, z AS (SELECT greatest(lat - 3, -90) AS s, lat + 3 AS n, CASE WHEN lon - 5 < -180 THEN lon + 355 ELSE lon - 5 END AS w, CASE WHEN lon + 5 > 180 THEN lon - 355 ELSE lon + 5 END AS e FROM places)
SELECT event_id FROM spread p WHERE NOT EXISTS (SELECT 1 FROM z WHERE p.lat BETWEEN z.s AND z.n AND CASE WHEN z.w <= z.e THEN p.lon BETWEEN z.w AND z.e OR (abs(p.lon) = 180 AND -p.lon BETWEEN z.w AND z.e) ELSE p.lon >= z.w OR p.lon <= z.e END)""")
def box_zones_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside all box zones, some of which cross the antimeridian."""
    lat, lon = F.col("lat"), F.col("lon")
    boxes = _places(spark, sf_dir).select(
        F.greatest(lat - 3, F.lit(-90.0)).alias("south"), F.when(lon - 5 < -180, lon + 355).otherwise(lon - 5).alias("west"), (lat + 3).alias("north"), F.when(lon + 5 > 180, lon - 355).otherwise(lon + 5).alias("east")
    )
    p = spread(spark, sf_dir)
    return p.join(inside_boxes(p, boxes, "event_id"), "event_id", "left_anti").select("event_id")


_EDGE = "(2*sin(400000/6371008.8/2)*(1+1e-9) + 1e-12)"


@query(f"""WITH {SPREAD}, v AS (SELECT *, floor(abs(lat)) AS d, CAST(event_id % 70 AS DOUBLE) AS m, CAST(event_id % 15 AS DOUBLE)/10 AS conf, event_id % 400 AS deg FROM spread)
SELECT event_id, CASE WHEN m < 60 AND d + m/60 <= 90 THEN CAST(d AS INT) END AS ddm_deg, CASE WHEN m < 60 AND d + m/60 <= 90 THEN m END AS ddm_min, CASE WHEN event_id % 2 = 0 THEN lat END AS datum_lat,
 CASE WHEN event_id % 2 = 0 THEN '{core.GCJ02}' END AS datum_crs, '{core.BD09}' AS named, CASE WHEN conf <= 1 THEN conf END AS raw_conf, CASE WHEN conf <= 1 THEN CASE WHEN lat < 0 THEN 'S' ELSE 'N' END END AS raw_text,
 CASE WHEN event_id % 7 > 0 THEN lon + 0.0::DOUBLE END AS ecef_y, CASE WHEN event_id % 7 > 0 THEN lat + 0.0::DOUBLE END AS enu_east, CASE WHEN event_id % 7 > 0 THEN lon + 0.0::DOUBLE END AS ned_down,
 CASE WHEN abs(lat*1.5) <= 90 AND event_id % 11 > 0 THEN round(lon*3 - 360*floor(lon*3/360), 9) + 0.0::DOUBLE END AS aer_azimuth, CASE WHEN abs(lat*1.5) <= 90 AND event_id % 11 > 0 THEN CAST(event_id % 11 - 1 AS DOUBLE) END AS aer_range,
 CASE WHEN abs(lat*1.2) <= 90 AND event_id % 35 <= 30 THEN CAST(event_id % 35 AS DOUBLE) END AS camera_zoom, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 4 * 100 AS DOUBLE) END AS view_width,
 CASE WHEN abs(lon*130000) <= pi()*6378137 AND abs(lat*300000) <= pi()*6378137 THEN lat*300000 + 0.0::DOUBLE END AS mercator_y, CASE WHEN event_id % 9 < 8 AND event_id % 10 < 8 THEN event_id % 10 END AS tile_y,
 CAST(event_id % 100 AS DOUBLE) AS height, CASE WHEN event_id % 3 > 0 THEN lat*2 END AS mapped, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 3 - 1 AS DOUBLE) END AS mapped_bound, CASE WHEN event_id % 2 = 0 THEN {0x8928308280FFFFF}::BIGINT END AS h3,
 CASE WHEN deg < 360 AND event_id % 3 < 2 THEN CAST(deg AS DOUBLE) END AS bearing, CASE WHEN deg < 360 THEN CASE event_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'T' END END AS bearing_of, CASE WHEN abs(lat*1.3) <= 90 AND event_id % 6 > 0 THEN CAST(event_id % 6 - 1 AS DOUBLE) END AS zone_radius,
 CAST(floor(cos(radians(lat))*cos(radians(lon))/{_EDGE}) AS INT) AS cx, CAST(floor(cos(radians(lat))*sin(radians(lon))/{_EDGE}) AS INT) AS cy, CAST(floor(sin(radians(lat))/{_EDGE}) AS INT) AS cz FROM v""")
def constructed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checked constructors keep and refuse of values that change from row to row, and the cells of points."""
    lat, lon, e = F.col("lat"), F.col("lon"), _e()
    of = lambda n, scale=1.0: (e % n).cast("double") / scale
    hemi, odd = F.when(lat < 0, "S").otherwise("N"), F.when(e % 7 == 0, F.lit(float("nan")))
    both = F.when(e % 2 == 0, core.gcj02(lat, lon)).otherwise(core.bd09(lat, lon))
    there = core.datum_point(both, core.GCJ02)
    ddm, raw = core.ddm(F.floor(F.abs(lat)), of(70), hemi), core.raw_source(hemi, of(15, 10.0))
    aer, bearing = geodesy.aer(lon * 3, lat * 1.5, of(11) - 1), capture.north_bearing(of(400), F.get(F.array(F.lit("m"), F.lit(" t"), F.lit("q")), (e % 3).cast("int")))
    mapped = core.approx_map(core.approx(lat, of(3) - 1), lambda v: v * 2.0)
    h3 = F.when(e % 2 == 0, F.lit(0x8928308280FFFFF)).otherwise(F.lit(0x8928308280FFFF0))
    return points_with_cells(spread(spark, sf_dir), 400_000.0).select(
        "event_id", ddm["deg"].alias("ddm_deg"), ddm["min"].alias("ddm_min"), there["lat"].alias("datum_lat"), core.crs_name(core.from_datum_point(there, core.GCJ02)).alias("datum_crs"),
        core.crs_name(core.bd09(lat, lon)).alias("named"), raw["confidence"].alias("raw_conf"), raw["raw"].alias("raw_text"), geodesy.ecef(lat, F.coalesce(odd, lon), lat)["y_m"].alias("ecef_y"),
        geodesy.enu(lat, F.coalesce(odd, lon), lon)["east_m"].alias("enu_east"), geodesy.ned(F.coalesce(odd, lon), lat, lon)["down_m"].alias("ned_down"), _r(aer["azimuth_deg"], 9).alias("aer_azimuth"), aer["range_m"].alias("aer_range"),
        mercator.camera(lat * 1.2, lon, of(35))["zoom"].alias("camera_zoom"), mercator.viewport(of(4) * 100, 600.0)["width_px"].alias("view_width"), mercator.mercator_point(lon * 130000, lat * 300000)["y_m"].alias("mercator_y"),
        mercator.tile_at(3, of(9), of(10))["y"].alias("tile_y"), core.height_length(core.with_height(core.wgs84(lat, lon), of(100), "ellipsoidal")).alias("height"), mapped["value"].alias("mapped"), F.when(mapped["value"].isNotNull(), mapped["max_error_m"]).alias("mapped_bound"),
        codes.h3_cell_id(h3).alias("h3"), bearing["degrees"].alias("bearing"), bearing["reference"].alias("bearing_of"), zone_circle(lat * 1.3, lon, of(6) - 1)["radius_m"].alias("zone_radius"), "cx", "cy", "cz",
    )


@query(f"""WITH {SPREAD} SELECT event_id, floor(((lat*0.3048 + lon*1609.344)*2 - 3*1852)/0.9144*1000 + 0.31415)::BIGINT AS length_myd, event_id % 3 = 0 AS is_finite, CASE WHEN event_id % 3 = 0 THEN lon + 0.0::DOUBLE END AS baidu_x,
 lon + 170 > 180 OR lon > 20 AS crosses, power(10.0::DOUBLE, 5 - event_id % 6) AS mgrs_side, CAST(event_id % 16 AS INT) AS h3_res, 6 AS geohash_length, floor(180.0/32768*110574)::BIGINT AS cell_m, 9 AS s2_level,
 floor(6378206.4*(1 - 1/294.9786982)*1000)::BIGINT AS b_mm, floor(1/294.9786982*(2 - 1/294.9786982)*1e12)::BIGINT AS e2_e12 FROM spread""")
def derived_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and multiples of lengths, finiteness, projected metres, crossings, sides and levels of cells, and an ellipsoid's axes."""
    lat, lon, e = F.col("lat"), F.col("lon"), _e()
    length = (core.from_unit(lat, "ft") + core.from_unit(lon, "mi")) * 2 - core.from_unit(3.0, "nmi")
    broken = F.when(e % 3 == 0, lon).when(e % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    east = F.when(lon + 170 > 180, lon - 190).otherwise(lon + 170)
    precision, clarke = privacy.Precision.at_least(500.0), geodesy.ELLIPSOIDS[core.NAD27]
    side = F.get(F.array(*[F.lit(codes.mgrs_side(k)) for k in range(6)]), (e % 6).cast("int"))
    h3 = F.lit(0x0800000000000000) + (e % 16) * (1 << 52)
    return spread(spark, sf_dir).select(
        "event_id", F.floor(core.to_unit(length, "yd") * 1000 + 0.31415).alias("length_myd"), core.finite(broken).alias("is_finite"), china.baidu_point(broken, lat)["x_m"].alias("baidu_x"),
        geodesy.box_crosses_antimeridian(geodesy.box(lat, lon, lat, east)).alias("crosses"), side.alias("mgrs_side"), grids.h3_resolution(h3).alias("h3_res"),
        F.lit(precision.level).alias("geohash_length"), F.lit(int(precision.min_cell_height_m)).cast("long").alias("cell_m"), F.lit(privacy.Precision.s2(9).level).alias("s2_level"),
        F.lit(int(clarke.b * 1000)).cast("long").alias("b_mm"), F.lit(int(clarke.e2 * 1e12)).cast("long").alias("e2_e12"),
    )


@query(f"""WITH {TOWN}, g AS (SELECT user_id % 40 AS track, ts, min(event_id) AS idx, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon, min(lat) <> max(lat) OR min(lon) <> max(lon) AS conflict FROM town GROUP BY track, ts)
SELECT track, epoch_us(ts) AS t_us, idx, round(lat, 7) + 0.0::DOUBLE AS lat, round(lon, 7) + 0.0::DOUBLE AS lon, conflict FROM g""")
def clean_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes of forty tracks, one for each instant, and whether others of that instant contradict it."""
    p = town(spark, sf_dir).select((F.col("user_id") % 40).alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), _e().alias("idx"), "lat", "lon")
    return clean_track(p).select(F.col("track_id").alias("track"), F.unix_micros("ts").alias("t_us"), "idx", _r(F.col("lat"), 7).alias("lat"), _r(F.col("lon"), 7).alias("lon"), "conflict")
