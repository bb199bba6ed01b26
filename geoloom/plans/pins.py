"""Registered queries of the pin hierarchy over the events' towns. They share one build a session and table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import pins as P
from geoloom.plans.queries import TOWN, query, town

_built: dict[tuple[str, str], P.Pins] = {}


def built(spark: SparkSession, sf_dir: str) -> P.Pins:
    """The hierarchy over all events, built once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = P.build_pins(town(spark, sf_dir), idx="event_id")
    return _built[key]


def levels_sql(points: str = "town", radius: float = 40.0 / 512.0) -> str:
    """The hierarchy as CTEs: ``pin`` has zoom, id, n, lat, lon, parent, first. Each zoom is settled by rounds over pairs in reach."""
    y = "least(greatest(0.5 - ln((1+sin(radians(least(greatest(lat,-85.05112877980659),85.05112877980659))))/(1-sin(radians(least(greatest(lat,-85.05112877980659),85.05112877980659)))))/(4*pi()), 0), 1)"
    out = [f"""n23 AS MATERIALIZED (SELECT min(event_id) AS id, lat AS klat, lon AS klon, lat, lon, count(*) AS n,
  count(*)*cos(radians(lat))*cos(radians(lon)) AS sx, count(*)*cos(radians(lat))*sin(radians(lon)) AS sy, count(*)*sin(radians(lat)) AS sz FROM {points} GROUP BY lat, lon)"""]
    for z in range(P.DEEPEST, -1, -1):
        r = radius / 2.0**z
        out.append(f"""p{z} AS MATERIALIZED (SELECT *, (lon+180)/360 AS x, {y} AS y, CAST(floor({y}/{r!r}) AS BIGINT) AS band FROM n{z + 1}),
e{z} AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM (SELECT *, band + unnest([-1, 0, 1]) AS at FROM p{z}) a JOIN p{z} b ON a.at = b.band
  WHERE (a.klat < b.klat OR (a.klat = b.klat AND (a.klon < b.klon OR (a.klon = b.klon AND a.id < b.id))))
  AND power(least(abs(a.x-b.x), 1-abs(a.x-b.x)), 2) + power(a.y-b.y, 2) <= {r!r}::DOUBLE*{r!r}::DOUBLE),
s{z} AS (SELECT id, 0 AS st, 0 AS it FROM p{z} UNION ALL
  SELECT v.id, CASE WHEN v.st > 0 THEN v.st WHEN count(*) FILTER (WHERE u.st = 1) > 0 THEN 2 WHEN count(*) FILTER (WHERE u.st = 0) = 0 THEN 1 ELSE 0 END, v.it + 1
  FROM s{z} v LEFT JOIN e{z} e ON e.b = v.id LEFT JOIN s{z} u ON u.id = e.a WHERE (SELECT count(*) FROM s{z} WHERE st = 0) > 0 GROUP BY v.id, v.st, v.it),
f{z} AS MATERIALIZED (SELECT id FROM s{z} WHERE st = 1 AND it = (SELECT max(it) FROM s{z})),
j{z} AS MATERIALIZED (SELECT id, id AS parent FROM f{z} UNION ALL
  SELECT e.b, arg_min(e.a, (q.klat, q.klon, q.id)) FROM e{z} e JOIN f{z} f ON f.id = e.a JOIN p{z} q ON q.id = e.a WHERE e.b NOT IN (SELECT id FROM f{z}) GROUP BY e.b),
g{z} AS (SELECT parent AS id, any_value(p.klat) FILTER (WHERE p.id = parent) AS klat, any_value(p.klon) FILTER (WHERE p.id = parent) AS klon,
  any_value(p.lat) FILTER (WHERE p.id = parent) AS lat0, any_value(p.lon) FILTER (WHERE p.id = parent) AS lon0, count(*) AS k, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sz) AS sz FROM p{z} p JOIN j{z} USING (id) GROUP BY parent),
n{z} AS MATERIALIZED (SELECT id, klat, klon, CASE WHEN k = 1 THEN lat0 ELSE degrees(atan2(sz, sqrt(sx*sx+sy*sy))) END AS lat, CASE WHEN k = 1 THEN lon0 ELSE degrees(atan2(sy, sx)) END AS lon, n, sx, sy, sz FROM g{z})""")
    for z in range(P.DEEPEST + 1):
        order = "ORDER BY klat, klon, c.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        if z:
            out.append(f"o{z} AS MATERIALIZED (SELECT c.id, j.parent, o.first + coalesce(sum(c.n) OVER (PARTITION BY j.parent {order}), 0) AS first FROM n{z} c JOIN j{z - 1} j USING (id) JOIN o{z - 1} o ON o.id = j.parent)")
        else:
            out.append(f"o0 AS MATERIALIZED (SELECT c.id, NULL::BIGINT AS parent, coalesce(sum(c.n) OVER ({order}), 0) AS first FROM n0 c)")
    rows = " UNION ALL ".join(f"SELECT {z} AS zoom, id, n, lat, lon, parent, first FROM n{z} JOIN o{z} USING (id)" for z in range(P.DEEPEST + 1))
    leaf = f"leaf AS MATERIALIZED (SELECT t.event_id AS idx, j.parent AS pin, o.first + row_number() OVER (PARTITION BY j.parent ORDER BY t.lat, t.lon, t.event_id) - 1 AS leaf FROM {points} t JOIN n23 a ON a.lat = t.lat AND a.lon = t.lon JOIN j{P.DEEPEST} j ON j.id = a.id JOIN o{P.DEEPEST} o ON o.id = j.parent)"
    return ",\n".join([*out, f"pin AS MATERIALIZED ({rows})", leaf])


_SQL = f"WITH RECURSIVE {TOWN},\n{levels_sql()}\n"


@query(f"{_SQL} SELECT zoom, id, n::BIGINT AS n, floor(lat*1000000 + 0.31415)::BIGINT AS lat_e6, floor(lon*1000000 + 0.31415)::BIGINT AS lon_e6, parent, first::BIGINT AS first FROM pin")
def pins_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pins of all zooms. Means of points on a grid lie on ties of plain rounding, hence the odd shift."""
    return built(spark, sf_dir).pins.select("zoom", "id", "n", *[F.floor(F.col(k) * 1000000 + 0.31415).alias(f"{k}_e6") for k in ("lat", "lon")], "parent", "first")


#: A view around each customer's own town, wider than high, of a zoom from 0 to 21.5; some cross the antimeridian.
_VIEWS = """v AS (SELECT c_custkey AS view, CAST((c_custkey*37) % 121 AS DOUBLE) - 60 AS vlat, CAST((c_custkey*91) % 351 AS DOUBLE) - 175 AS vlon, CAST(c_custkey % 44 AS DOUBLE)/2 AS vzoom FROM customer),
b AS (SELECT view, vzoom, least(40.0::DOUBLE, 200/power(2, vzoom)) AS h, least(170.0::DOUBLE, 400/power(2, vzoom)) AS w, vlat, vlon FROM v),
box AS (SELECT view, CAST(floor(vzoom) AS INTEGER) AS zoom, greatest(vlat - h, -89.5) AS south, least(vlat + h, 89.5) AS north,
  CASE WHEN vlon - w < -180 THEN vlon - w + 360 ELSE vlon - w END AS west, CASE WHEN vlon + w > 180 THEN vlon + w - 360 ELSE vlon + w END AS east FROM b)"""


@query(f"""{_SQL}, {_VIEWS} SELECT view, pin.zoom, pin.id, n::BIGINT AS n FROM box JOIN pin ON pin.zoom = box.zoom AND lat BETWEEN south AND north
 AND CASE WHEN west <= east THEN lon BETWEEN west AND east OR (abs(lon) = 180 AND -lon BETWEEN west AND east) ELSE lon >= west OR lon <= east END""")
def pins_in_map_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pins that each customer's map shows, by one join of views with pins."""
    k, one = F.col("c_custkey"), lambda x: x.cast("double")
    v = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("view"), (one((k * 37) % 121) - 60.0).alias("vlat"), (one((k * 91) % 351) - 175.0).alias("vlon"), (one(k % 44) / 2.0).alias("zoom")
    )
    h, w = F.least(F.lit(40.0), F.lit(200.0) / F.pow(F.lit(2.0), "zoom")), F.least(F.lit(170.0), F.lit(400.0) / F.pow(F.lit(2.0), "zoom"))
    west, east = F.col("vlon") - w, F.col("vlon") + w
    v = v.select(
        "view", "zoom", F.greatest(F.col("vlat") - h, F.lit(-89.5)).alias("south"), F.least(F.col("vlat") + h, F.lit(89.5)).alias("north"),
        F.when(west < -180.0, west + 360.0).otherwise(west).alias("west"), F.when(east > 180.0, east - 360.0).otherwise(east).alias("east"),
    )
    return P.pins_in_views(built(spark, sf_dir).pins, v).select("view", "zoom", "id", "n")


@query(f"""{_SQL} SELECT p.zoom, p.id, l.leaf - p.first AS nth, l.idx FROM pin p JOIN leaf l ON l.leaf >= p.first + 2 AND l.leaf < p.first + least(p.n, 7) WHERE p.zoom % 5 = 2""")
def pin_leaf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to the seventh point of every pin of five zooms, by ranges of leaf numbers."""
    p = built(spark, sf_dir)
    asked = p.pins.where("zoom % 5 = 2").select("zoom", "id", F.lit(2).alias("start"), F.lit(5).alias("size"))
    return P.pin_leaves(p, asked).select("zoom", "id", F.col("nth").cast("long").alias("nth"), "idx")


@query(f"""{_SQL} SELECT p.zoom, p.id, count(*) AS children, sum(c.n)::BIGINT AS n, string_agg(c.id::VARCHAR, ',' ORDER BY c.first) AS ids FROM pin p JOIN pin c ON c.zoom = p.zoom + 1 AND c.parent = p.id GROUP BY p.zoom, p.id""")
def pin_children_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pin's children in order; a pin has only so many, as they lie within its reach."""
    p = built(spark, sf_dir).pins
    kids = p.where("parent IS NOT NULL").groupBy((F.col("zoom") - 1).alias("zoom"), F.col("parent").alias("id")).agg(
        F.count("*").alias("children"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "id"))).alias("kids")
    )
    return kids.select("zoom", "id", "children", "n", F.array_join(F.transform("kids", lambda k: k["id"].cast("string")), ",").alias("ids"))
