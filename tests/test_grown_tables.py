"""Odd values and crowded places that larger tables bring."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions.geodesy import box_contains, haversine
from geoloom.operators.joins import radius_join, reverse_lookup
from geoloom.operators.tracks import inside_boxes, zones_strip
from geoloom.plans.queries import QUERIES
from geoloom.sources.capture import from_xmp


def globe(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    odd = [(90.0, 12.0), (-90.0, -7.0), (0.0, 180.0), (0.0, -180.0), (-0.0, 0.0), (45.0, 179.999999), (math.nan, 3.0), (None, 3.0)]
    return [(k, *p) for k, p in enumerate(odd + [(round(r.uniform(-90, 90), 2), round(r.uniform(-180, 180), 2)) for _ in range(n - len(odd))])]


def events_at(spark, folder, keys: list[tuple]) -> str:
    spark.createDataFrame(keys, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_utm_gives_back_the_antimeridian(spark, tmp_path):
    """Event 0 lies at 53.0452 S 180 E, whose way back comes out a hair east of the antimeridian."""
    lat, lon = 269548, 3600000
    # event_id and user_id that spread() puts there: two congruences, by trial over user_id.
    for user in range(3600001):
        event = (lon - user * 32452843) * pow(15485863, -1, 3600001) % 3600001
        if (event * 7919 + user * 104729) % 1600001 == lat:
            break
    where = events_at(spark, tmp_path, [(event, user, None, "view")])
    [row] = QUERIES["utm_roundtrip"](spark, where).collect()
    assert (row.lat, row.lon, row.same) == (-53.0452, -180.0, True)


@pytest.mark.parametrize("few", [False, True])
def test_boxes_by_covered_cells(spark, few):
    r = random.Random(5)
    edges = [(-90.0, -180.0, -88.5, 180.0), (10.0, 170.0, 12.0, -170.5), (-3.0, 179.5, 3.0, 179.25), (89.0, 3.0, 90.0, 4.0), (5.0, 5.0, 4.0, 9.0), (20.0, 30.0, 20.0, 30.0)]
    for _ in range(5 if few else 60):
        s, w = r.uniform(-90, 80), r.uniform(-180, 180)
        edges.append((s, w, s + r.uniform(0, 9), (w + r.uniform(0, 40) + 180) % 360 - 180))
    boxes = spark.createDataFrame(edges, "south double, west double, north double, east double")
    fixes = spark.createDataFrame(globe(3000, 6), "idx long, lat double, lon double")
    want = fixes.join(boxes, box_contains(F.struct("south", "west", "north", "east"), "lat", "lon")).select("idx").distinct()
    assert sorted(x.idx for x in inside_boxes(fixes, boxes).collect()) == sorted(x.idx for x in want.collect())
    plan = inside_boxes(fixes, boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert "merge" in plan  # parts of boxes aren't broadcast


def test_zones_by_covered_cells(spark):
    r = random.Random(7)
    sizes = [0.0, 0.5, 1.0, 40.0, 50_000.0, 400_000.0, 3e6, 1e7, 2.1e7]
    circles = [(k, 45.0 if k < 3 else r.uniform(-90, 90), 179.999999 if k < 3 else r.uniform(-180, 180), sizes[k % 8]) for k in range(80)] + [(99, 0.0, 0.0, -1.0), (98, 0.0, 0.0, None)]
    for circles in (circles, [(k, la, lo, min(x, 300_000.0) if x else x) for k, la, lo, x in circles], [(0, 0.0, 0.0, 2.1e7)]):
        zones = spark.createDataFrame(circles, "zone_id long, lat double, lon double, radius_m double")
        fixes = spark.createDataFrame(globe(3000, 8), "idx long, lat double, lon double")
        z = zones.toDF("zone_id", "zlat", "zlon", "radius_m")
        want = fixes.join(z, F.col("lat").between(-90, 90) & (haversine("lat", "lon", "zlat", "zlon") <= F.col("radius_m")), "left_anti")
        assert sorted(x.idx for x in zones_strip(fixes, zones).collect()) == sorted(x.idx for x in want.collect())


def test_radius_join_and_nearest_place_by_rings(spark):
    places = [(k, la, lo, k % 4 if k % 9 else None, k * 10 if k % 5 else None) for k, la, lo in globe(300, 9)]
    # A town of places, and places beyond it at the same position.
    places += [(1000 + k, 10.0 + k % 20 / 1e4, 20.0, 3, 5000) for k in range(200)]
    p = spark.createDataFrame(places, "idx long, lat double, lon double, class int, population long")
    q = spark.createDataFrame(globe(600, 10), "qid long, lat double, lon double")
    met = q.join(p.toDF("idx", "plat", "plon", "class", "population"), haversine("lat", "lon", "plat", "plon") <= 2_000_000.0).withColumn("m", haversine("lat", "lon", "plat", "plon")).where("NOT isnan(m) AND lat IS NOT NULL AND plat IS NOT NULL")
    got = radius_join(q, p, 2_000_000.0, "qid", "idx")
    assert sorted((x.qid, x.pid) for x in got.collect()) == sorted((x.qid, x.idx) for x in met.collect())
    best = met.where("class >= 2 AND population >= 500").groupBy("qid").agg(F.min(F.struct("m", "idx")).alias("b")).select("qid", "b.idx")
    want = dict.fromkeys(range(600)) | {x.qid: x.idx for x in best.collect()}
    assert {x.qid: x.place_idx for x in reverse_lookup(q, p, 2_000_000.0, 500, 2).collect()} == want
    assert {x.qid: x.place_idx for x in reverse_lookup(q, p.limit(0), 2_000_000.0).collect()} == dict.fromkeys(range(600))


def test_a_crowded_cell_is_more_than_one_task(spark, monkeypatch):
    """All pairs of a town: its queries are dealt in parts, each with all the points around; other cells, poles and the antimeridian stay whole."""
    from geoloom.operators import joins

    monkeypatch.setattr(joins, "_PART", 50, raising=False)
    r = random.Random(13)
    town = [(1000 + k, 48.0 + r.random() / 10, 2.0 + r.random() / 10) for k in range(700)]
    q = spark.createDataFrame(globe(400, 14) + town + town[:20], "qid long, lat double, lon double")
    p = spark.createDataFrame(globe(300, 15) + town[:200] + [(None, 48.0, 2.0)], "pid long, lat double, lon double")
    for meters in (0.5, 2_000.0, 400_000.0, 1.9e7, 2.1e7):
        met = q.join(p.toDF("pid", "plat", "plon"), haversine("lat", "lon", "plat", "plon") <= meters).where("lat IS NOT NULL AND plat IS NOT NULL").select("qid", "pid", haversine("lat", "lon", "plat", "plon").alias("m"))
        got = radius_join(q, p, meters)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, met.collect())))
        if meters == 400_000.0:
            near = got.where("qid >= 1000").groupBy(F.spark_partition_id()).count().collect()
            assert len(near) > 2 and max(x["count"] for x in near) < 0.6 * sum(x["count"] for x in near) and sum(x["count"] for x in near) > 700 * 200
    assert radius_join(q.limit(0), p, 400_000.0).collect() == radius_join(q, p.limit(0), 400_000.0).collect() == []


def test_xmp_tags_are_cleaned_once(spark):
    """Cleaning steps in the plan, not seconds: each of the 13 tags is cleaned where it is read, whatever the number of rules that ask for it."""
    names = ["latitude", "longitude", "altitude", "altitude_ref", "map_datum", "speed", "speed_ref", "img_direction", "img_direction_ref", "time_stamp"]
    tags = spark.createDataFrame([("48,12.5N", "11,30.25E", "5", "1", None, "36", "K", "270", "t", "2024-01-02T03:04:05Z"), ("48,62.5N", "11,30.25E", *[None] * 8)], ", ".join(f"{k} string" for k in names))
    gps = tags.select(F.struct(*names).alias("gps"))
    made = gps.select(from_xmp(F.col("gps"), gps.schema["gps"].dataType).alias("x"))
    assert [(r.x.lat, r.x.lon, r.x.height_m, r.x.speed_mps, r.x.error_kind) for r in made.collect()] == [(48 + 12.5 / 60, 11 + 30.25 / 60, -5.0, 10.0, None), (None, None, None, None, "Syntax")]
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace(") < 60


def test_steps_of_grids_and_datums_are_worked_out_once(spark, monkeypatch):
    """Steps in the plan, not seconds: nothing that a formula uses more than once is written out again."""
    from geoloom.functions import china, codes, core, grids

    p = spark.createDataFrame([("31UDQ4825111932", 48.9, 2.3)], "code string, lat double, lon double")
    plan = lambda x: p.select(x.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan(grids.utm("lat", "lon")).count("pmod(") < 10
    assert plan(codes.mgrs_decode(F.lower("code"))).count("lower(") == 1
    assert plan(grids.utm_inverse(grids.utm("lat", "lon"))).lower().count("atanh(") < 8
    assert len(plan(china.to_crs(core.coordinate("lat", "lon", core.BD09), core.WGS84))) < 300_000
    assert plan(codes.plus_code_decode(F.lower(grids.plus_code("lat", "lon", 11)))).count("lower(") == 1
    assert plan(codes.geohash_decode(F.upper(grids.geohash("lat", "lon", 5)))).count("upper(") == 1


def test_rows_leave_the_search_for_a_geodesic(monkeypatch):
    """Rows that are settled aren't worked on until the last one of their batch is; points of the equator lie on it."""
    import numpy as np

    from geoloom.functions.geodesic import Geodesic, track_foot

    g, rows, hybrid = Geodesic(), [], Geodesic._hybrid
    monkeypatch.setattr(Geodesic, "_hybrid", lambda self, b1, *a: rows.append(len(b1)) or hybrid(self, b1, *a))
    r = np.random.default_rng(2)
    lat1, lat2, lon1, lon2 = *r.uniform(-80, 80, (2, 4000)), *r.uniform(-180, 180, (2, 4000))
    lat2[0], lon2[0] = -lat1[0] + 0.01, lon1[0] + 179.9  # hardly any is as slow as one that faces its end
    s, a, _ = g.inverse(lat1, lon1, lat2, lon2)
    assert sum(rows) < 12 * 4000
    lat, lon, _ = g.direct(lat1, lon1, a, s)
    assert np.abs(lat - lat2).max() < 1e-9 and np.abs((lon - lon2 + 180) % 360 - 180).max() < 1e-8
    rows.clear()
    cross, along = track_foot(g, lat2, lon2, lat1, lon1, lat1 + 1.0, lon1 + 1.0)
    assert sum(rows) < 200 * 4000 and not np.isnan(cross + along).any()
    s, a, b = g.inverse(0.0, np.array([10.0, 0.0, 3.0]), 0.0, np.array([100.0, -30.0, 3.0]))
    assert np.allclose(s, [6378137.0 * np.pi / 2, 6378137.0 * np.pi / 6, 0.0]) and a.tolist() == b.tolist() == [90.0, 270.0, 0.0]


def test_a_segment_is_passed_once(spark):
    """The nearer of a segment's start and the place beside it is taken in the row, not by a row for each."""
    from geoloom.operators.tracks import estimate_offset

    track = spark.createDataFrame([(1, f"2024-01-01 00:0{k}:00", 0.0, k / 10) for k in range(5)], "track_id long, ts string, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    photos = spark.createDataFrame([(1, "2024-01-01 00:01:28", 0.01, 0.15), (1, "2024-01-01 00:01:58", 0.0, 0.2)], "track_id long, ts string, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    got = estimate_offset(track, photos)
    assert [(r.track_id, r.offset_ms, r.n) for r in got.collect()] == [(1, 2000, 2)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_density_looks_around_without_shuffling_what_it_looks_for(spark, monkeypatch, capsys):
    """Positions travel by tile, to their own and to those beside them; the cells that each of them looks into don't."""
    from geoloom.operators import dbscan as D

    points = spark.createDataFrame([(i, 48.0 + i * 1e-4, 2.0 + (i * 7 % 40) * 1e-4) for i in range(60)], "idx long, lat double, lon double")
    edge = D.chord(25.0) / 3**0.5 * (1 - 1e-4)
    spots, plans, write = D._spots(points, edge, 4), [], D.written

    def explained(df):
        df.explain()
        plans.append(capsys.readouterr().out)
        return write(df)

    monkeypatch.setattr(D, "written", explained)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        D._near(spots, 25.0, edge, 3**0.5 * 1.001)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0].count("Exchange hashpartitioning(tile") == plans[0].count("Exchange ") == 2


def test_links_within_a_tile_are_joined_there(spark, monkeypatch):
    """A town's cells come to the rounds of pointers as a root for each tile, not pair by pair; smaller tiles and cells without short cuts say the same."""
    from geoloom.operators import dbscan as D

    r = random.Random(3)
    at = [(48.0 + r.random() * 2e-3, 2.0 + r.random() * 3e-3) for _ in range(900)] + [(49.0 + k * 1e-4, 2.0 + k % 3 * 1e-4) for k in range(40)] + [(50.0, 2.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "idx long, lat double, lon double")
    rounds, edges = D.components, []
    monkeypatch.setattr(D, "components", lambda links: edges.append(links.count()) or rounds(links))
    said = []
    for tile, few in ((32, 32), (5, 32), (5, 0)):
        monkeypatch.setattr(D, "_TILE", tile)
        monkeypatch.setattr(D, "_FEW", few)
        said.append(sorted(tuple(x) for x in D.dbscan(points, 25.0, 4).collect()))
    assert said[0] == said[1] == said[2] and len({c for _, c, _ in said[0]}) > 2
    assert edges[0] < 20 < edges[1], edges


@pytest.mark.parametrize("grid", ["geohash", "s2"])
def test_a_cell_is_not_read_back_from_its_name(spark, grid):
    """The middle comes from the cell's place, and is that of the code."""
    from geoloom.functions import codes, grids, privacy

    frame = spark.createDataFrame(globe(400, 12), "idx long, lat double, lon double").where("lat IS NOT NULL AND abs(lat) < 90 AND lon < 180")
    name, decode = {"geohash": (grids.geohash, codes.geohash_decode), "s2": (grids.s2_cell, codes.s2_decode)}[grid]
    for level in (1, 2, 5, 12):
        made = frame.select(privacy.coarsen("lat", "lon", privacy.Precision.of(grid, level)).alias("x"), decode(name("lat", "lon", level)).alias("d"))
        assert [r for r in made.collect() if (r.x.lat, r.x.lon, r.x.max_error_m) != tuple(r.d)] == []
    plan = frame.select(privacy.coarsen("lat", "lon", privacy.Precision.of(grid, 12)).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "rlike" not in plan.lower() and "aggregate(transform" not in plan and "sequence(" not in plan


def test_fixes_are_not_paired_with_the_circles_around_them(spark):
    """Circles upon circles: a fix is told once by its cell, or by the first circle that holds it; ones at a circle's edge are exact."""
    r = random.Random(11)
    circles = [(k, 10.0 + r.random() / 10, 20.0 + r.random() / 10, 40_000.0 + 100 * k) for k in range(200)] + [(200, -90.0, 0.0, 3e5), (201, 0.0, 180.0, 1000.0)]
    zones = spark.createDataFrame(circles, "zone_id long, lat double, lon double, radius_m double")
    at = [(10 + r.uniform(-0.7, 0.7), 20 + r.uniform(-0.7, 0.7)) for _ in range(1500)] + [(-90.0, 77.0), (0.0, -180.0), (0.0, -179.99), (0.0, 179.99), (95.0, 20.0), (None, 20.0), (math.nan, 20.0)]
    fixes = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "idx long, lat double, lon double")
    got = zones_strip(fixes, zones)
    z = zones.toDF("zone_id", "zlat", "zlon", "radius_m")
    want = fixes.join(z, F.col("lat").between(-90, 90) & (haversine("lat", "lon", "zlat", "zlon") <= F.col("radius_m")), "left_anti")
    assert sorted(x.idx for x in got.collect()) == sorted(x.idx for x in want.collect()) and 100 < got.count() < 1400
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "Join Inner" not in plan


def test_plus_codes_are_read_by_place(spark):
    """No list of digits is made of a code; long, padded and wrong ones are read as before."""
    from geoloom.functions import codes

    rows = [("8FVC9G8F+6X", 47.365, 8.524875), ("8fvc0000+", 47.5, 8.5), ("8FVC9G8F+6XC", None, None), ("8FVC9G8F+", None, None), ("9G8F+6X", None, None), ("8FVC9G8F+6", None, None)]
    frame = spark.createDataFrame(rows, "code string, south double, west double")
    made = frame.select("code", codes.plus_code_bounds(F.col("code")).alias("b"))
    got = {r.code: r.b for r in made.collect()}
    assert [round(x, 9) for x in got["8FVC9G8F+6X"]] == [47.3655, 8.524875, 47.365625, 8.525] and list(got["8fvc0000+"]) == [47.0, 8.0, 48.0, 9.0]
    assert got["9G8F+6X"] is None and got["8FVC9G8F+6"] is None and round(got["8FVC9G8F+"].north - got["8FVC9G8F+"].south, 9) == 0.0025
    assert round((got["8FVC9G8F+6XC"].east - got["8FVC9G8F+6XC"].west) / 0.00003125, 6) == 1.0
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "sequence(" not in plan and "split(" not in plan
