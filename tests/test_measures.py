"""Known values of measures, datums and codes, and brute force for clusters and stay points."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import china, codes, core, geodesic, geodesy, grids, mercator, privacy, rhumb
from geoloom.operators.dbscan import dbscan
from geoloom.operators.tracks import segment_visits
from geoloom.sources import interchange


def _one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_geodesics(spark):
    # Published examples of the inverse and direct problem on WGS-84.
    r = _one(spark, geodesic.inverse(40.6, -73.8, 51.6, -0.5), geodesic.inverse(0.0, 0.0, 0.5, 179.5), geodesic.destination(40.6, -73.8, 45.0, 1e7), geodesic.inverse(0.0, 0.0, 0.0, 180.0))
    assert r.c0.distance_m == pytest.approx(5551759.400319, abs=1e-5) and r.c0.initial_deg == pytest.approx(51.198882845579, abs=1e-9)
    assert r.c1.distance_m == pytest.approx(19936288.578965, abs=1e-5) and r.c1.initial_deg == pytest.approx(25.671872868, abs=1e-6)
    assert r.c2.lat == pytest.approx(32.64284433, abs=1e-7) and r.c2.lon == pytest.approx(49.01103958, abs=1e-7)
    assert r.c3.distance_m == pytest.approx(20003931.458625, abs=1e-5) and 0 <= r.c3.final_deg < 360
    ends = F.array(*[F.struct(F.lit(x).alias("lat"), F.lit(0.0).alias("lon")) for x in (1.0, 3.0, -2.0)])
    r = _one(spark, geodesic.farthest(0.0, 0.0, ends), geodesic.farthest(0.0, 0.0, F.array().cast("array<struct<lat:double,lon:double>>")), geodesic.intermediate(0.0, 0.0, 0.0, 2.0, 1.5), geodesic.track_offset(1.0, 1.0, 0.0, 0.0, 0.0, 0.0))
    e2 = 0.0066943799901413165
    step = math.radians(3.0) / 3000
    arc = sum(6378137.0 * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * step) ** 2) ** 1.5 * step for k in range(3000))
    assert r.c0 == pytest.approx(arc, abs=1e-3) and r.c1 is None and r.c2.lat is None and r.c3.cross_m is None


def test_rhumb_lines_and_poles(spark):
    r = _one(
        spark, rhumb.rhumb_distance(0.0, 0.0, 0.0, 90.0), rhumb.rhumb_distance(0.0, 10.0, 90.0, -50.0), rhumb.rhumb_bearing(10.0, 170.0, 10.0, -170.0), rhumb.rhumb_bearing(90.0, 0.0, 10.0, 30.0),
        rhumb.rhumb_bearing(5.0, 5.0, 5.0, 5.0), rhumb.rhumb_destination(89.0, 10.0, 0.0, 222_000.0), rhumb.rhumb_destination(89.0, 10.0, 20.0, 1e6), rhumb.rhumb_destination(10.0, 10.0, 90.0, 0.0), rhumb.rhumb_destination(1.0, 1.0, 0.0, -1.0),
    )
    assert r.c0 == pytest.approx(6378137.0 * math.pi / 2, abs=1e-3) and r.c1 == pytest.approx(10001965.729, abs=1e-2)
    assert r.c2 == pytest.approx(90.0) and r.c3 == pytest.approx(150.0) and r.c4 is None
    assert r.c5.lat == pytest.approx(89.012, abs=0.01) and r.c5.lon == pytest.approx(-170.0) and r.c6 is None and r.c7.lat == 10.0 and r.c8 is None


def test_datums(spark):
    r = _one(
        spark, china.wgs84_to_gcj02(39.915, 116.404), china.gcj02_to_bd09(39.915, 116.404), china.bd09_to_gcj02_fast(39.915, 116.404), china.gcj02_to_wgs84_fast(39.915, 116.404),
        china.to_crs(core.coordinate(39.915, 116.404, core.BD09), core.BD09), china.bd09_to_baidu(39.9, 116.4), china.bd09_to_baidu(75.0, 0.0), china.to_crs(core.coordinate(39.915, 116.404), core.BD09),
    )
    want = [(39.91640428150164, 116.41024449916938), (39.92133699351021, 116.41036949371029), (39.90865673957631, 116.39762729119315), (39.91359571849836, 116.39775550083061), (39.915, 116.404)]
    for got, (lat, lon) in zip(r, want):
        assert got.lat == pytest.approx(lat, abs=1e-13) and got.lon == pytest.approx(lon, abs=1e-12)
    assert r.c4.max_error_m == 0.0 and r.c5.x_m > 1.29e7 and r.c6 is None
    assert r.c7.lat == pytest.approx(39.922699552216216, abs=1e-12) and r.c7.lon == pytest.approx(116.41662724378733, abs=1e-12)


def test_utm_and_tokyo(spark):
    # A published conversion: the tower in Toronto.
    u = grids.utm(43.642566667, -79.387138889)
    r = _one(spark, u, grids.utm_inverse(u), geodesy.shift_datum(35.0, 139.0, core.TOKYO), geodesy.DatumTransform.to_wgs84(core.TOKYO).reverse().apply(35.0, 139.0, 10.0))
    assert (r.c0.zone, r.c0.hemi) == (17, "N") and r.c0.easting_m == pytest.approx(630084.3, abs=1.0) and r.c0.northing_m == pytest.approx(4833438.6, abs=1.0)
    assert r.c1.lat == pytest.approx(43.642566667, abs=1e-10) and r.c1.lon == pytest.approx(-79.387138889, abs=1e-9)
    assert r.c2.lat == pytest.approx(35.00324, abs=2e-4) and r.c2.lon == pytest.approx(138.99677, abs=2e-4) and r.c3.height_m is not None
    with pytest.raises(ValueError):
        geodesy.DatumTransform.checked(core.WGS84, core.GCJ02, geodesy.Helmert(0, 0, 0))


def test_codes_that_are_none(spark):
    none = [
        codes.parse_geohash(F.lit("abc")), codes.parse_maidenhead(F.lit("ZZ00")), codes.parse_plus_code(F.lit("9C3W9QCJ")), codes.parse_plus_code(F.lit("9QCJ+2V")), codes.mgrs_decode(F.lit("61NAA")), codes.mgrs_decode(F.lit("31NIA12")),
        codes.mgrs_decode(F.lit("32XNA")), codes.mgrs_decode(F.lit("31NAA123")), codes.s2_decode(F.lit(2).cast("bigint")), codes.ups(50.0, 0.0), codes.utm_reference(32, F.lit("N"), 500000.0, 1e8),
    ]
    assert list(_one(spark, *none)) == [None] * len(none)
    r = _one(spark, codes.mgrs_decode(F.lit("4 q fj 1 6")), codes.plus_code_decode(F.lit("8FVC0000+")), codes.maidenhead_decode(F.lit("jn58TD")), codes.mgrs_decode(F.lit("zah0000000000")))
    assert r.c0.code == "04QFJ16" and r.c1.lat == pytest.approx(47.5) and r.c1.lon == pytest.approx(8.5)
    assert r.c2.lat == pytest.approx(48.1458333, abs=1e-6) and r.c2.lon == pytest.approx(11.625, abs=1e-6) and r.c3.lat == pytest.approx(90.0, abs=1e-4)


def test_privacy(spark):
    assert privacy.Precision.at_least(4000.0) == ("geohash", 5) and privacy.Precision.s2(3).min_cell_height_m is None
    for wrong in (lambda: privacy.Precision.geohash(13), lambda: privacy.Precision.at_least(1e9), lambda: privacy.Precision.of("h3", 1)):
        with pytest.raises(ValueError):
            wrong()
    r = _one(spark, privacy.coarsen(10.0, 180.0, privacy.Precision.geohash(5)), privacy.coarsen(10.0, -180.0, privacy.Precision.geohash(5)), privacy.coarsen(90.0, 55.0, privacy.Precision.s2(4)), privacy.coarsen(90.0, -5.0, privacy.Precision.s2(4)))
    assert r.c0 == r.c1 and r.c2 == r.c3 and r.c0.source.startswith("privacy:geohash:")


def test_labels(spark):
    counts = [0, 999, 1000, 1049, 1050, 1250, 9949, 9999, 10_000, 12_499, 12_500]
    frame = spark.createDataFrame([(c,) for c in counts], "c long")
    assert [r[0] for r in frame.select(mercator.abbreviated(F.col("c"))).collect()] == ["0", "999", "1k", "1k", "1.1k", "1.3k", "9.9k", "10k", "10k", "12k", "13k"]


@pytest.mark.parametrize(
    ("kind", "text", "error"),
    [
        ("geojson", '{"type":"Point","coordinates":[1]}', "Syntax"), ("geojson", "[" * 200 + "]" * 200, "TooDeep"), ("geojson", '{"type":"Point","coordinates":[200,0]}', "OutOfRange"), ("geojson", "", "Syntax"),
        ("wkt", "POINT (1 2", "Syntax"), ("wkt", "POINT (1)", "Syntax"), ("wkt", "POINT M (1 2)", "Syntax"), ("wkt", "POINT (1 2))", "Syntax"), ("wkt", "GEOMETRYCOLLECTION(" * 200 + "POINT(1 2)" + ")" * 200, "TooDeep"),
        ("gpx", "<gpx><wpt lat='1'/></gpx>", "Syntax"), ("gpx", "<kml/>", "Syntax"), ("kml", "<kml><Point></Point></kml>", "Syntax"), ("kml", "<kml><Folder></kml>", "Syntax"),
        ("kml", "<kml>" + "<Folder>" * 40 + "</Folder>" * 40 + "</kml>", "TooDeep"),
    ],
)
def test_faulty_documents(spark, kind, text, error):
    r = spark.createDataFrame([(text,), (None,)], "t string").select(interchange.READERS[kind](F.col("t")).alias("p")).collect()
    assert r[0].p.error_kind == error and r[0].p.positions is None and r[1].p is None


def test_documents_without_positions(spark, tmp_path):
    texts = {"geojson": '{"type":"Feature","geometry":null,"properties":null}', "wkt": "POLYGON EMPTY", "gpx": "<gpx/>", "kml": "<kml/>"}
    for kind, text in texts.items():
        r = spark.createDataFrame([(text,)], "t string").select(interchange.READERS[kind](F.col("t")).alias("p")).first()
        assert r.p.positions == [] and r.p.error_kind is None
    for name, text in (("a", "LINESTRING (1 2,\n 3 4)"), ("b", "LINESTRING (1"), ("c", "POLYGON EMPTY")):
        (tmp_path / f"{name}.wkt").write_text(text)
    got = interchange.read_documents(spark, str(tmp_path), "wkt").select(F.element_at(F.split("file", "/"), -1), "error_kind", "nth", "lat", "lon").collect()
    assert sorted(map(tuple, got), key=repr) == [("a.wkt", None, 0, 2.0, 1.0), ("a.wkt", None, 1, 4.0, 3.0), ("b.wkt", "Syntax", None, None, None), ("c.wkt", None, None, None, None)]


def _meters(a, b) -> float:
    p, q, dl = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_dbscan_by_brute_force(spark):
    rng = random.Random(8)
    at = [(round(48 + rng.randrange(60) * 1e-4, 6), round(2 + rng.randrange(60) * 1e-4, 6)) for _ in range(300)]
    near = [[j for j in range(300) if _meters(at[i], at[j]) <= 30.0] for i in range(300)]
    core_ = [len(x) >= 4 for x in near]
    label: dict[int, int] = {}
    for i in range(300):
        if core_[i] and i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += [j for j in near[k] if core_[j]]
    for i in range(300):
        if not core_[i] and (found := [(_meters(at[i], at[j]), at[j], label[j]) for j in near[i] if core_[j]]):
            label[i] = min(found)[2]
    first = sorted({min(k for k in label if label[k] == c): c for c in set(label.values())}.items())
    number = {c: n for n, (_, c) in enumerate(first)}
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "idx long, lat double, lon double")
    got = {r.idx: (r.cluster_id, r.is_core) for r in dbscan(frame, 30.0, 4).collect()}
    assert got == {i: (number[label[i]] if i in label else None, core_[i]) for i in range(300)}
    assert len(first) > 3


def test_stay_points_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(t, k, rng.randrange(0, 40_000), 10 + rng.randrange(4) * 1e-3, 20 + rng.randrange(3) * 1e-3) for t in range(4) for k in range(150)]
    want = set()
    for t in range(4):
        own = sorted((s, lat, lon, k) for u, k, s, lat, lon in rows if u == t)
        i = 0
        while i < len(own):
            j = i + 1
            while j < len(own) and _meters(own[i][1:3], own[j][1:3]) <= 150.0:
                j += 1
            if own[j - 1][0] - own[i][0] >= 300:
                want.add((t, own[i][0], own[j - 1][0], j - i, own[i][3]))
                i = j
            else:
                i += 1
    frame = spark.createDataFrame(rows, "track_id long, idx long, s long, lat double, lon double").withColumn("ts", F.timestamp_seconds("s"))
    got = segment_visits(frame, 150.0, 300.0).select("track_id", F.unix_seconds("arrival"), F.unix_seconds("departure"), "n_fixes", "anchor_idx").collect()
    assert {tuple(r) for r in got} == want and want


def test_box_zones_at_poles_and_the_antimeridian(spark):
    from geoloom.operators.tracks import inside_boxes

    boxes = spark.createDataFrame([(80.0, 10.0, 90.0, 20.0), (-5.0, 170.0, 5.0, -170.0), (20.0, 30.0, 20.0, 30.0)], "south double, west double, north double, east double")
    at = [(90.0, -77.0), (85.0, 15.0), (85.0, 25.0), (0.0, 180.0), (0.0, -180.0), (5.0, -170.0), (5.0, 169.0), (20.0, 30.0), (-90.0, 15.0)]
    fixes = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "idx long, lat double, lon double")
    assert sorted(r.idx for r in inside_boxes(fixes, boxes).collect()) == [0, 1, 3, 4, 5, 7]


def test_a_crowded_position_is_one_row(spark):
    # A third of all points at one place, a bridge to a second place, and a lone one.
    at = [(10.0, 20.0)] * 3000 + [(10.0002, 20.0)] + [(10.0004, 20.0)] * 4 + [(11.0, 20.0)] * 3 + [(None, 20.0)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "idx long, lat double, lon double")
    got = {r.idx: (r.cluster_id, r.is_core) for r in dbscan(frame, 25.0, 4).collect()}
    same = {r.idx: (r.cluster_id, r.is_core) for r in dbscan(frame, 0.0, 4).collect()}
    assert {same[i] for i in range(3000)} == {(0, True)} and same[3000] == (None, False) and same[3001] == (1, True) and same[3008] == (None, False)
    assert set(got[i] for i in range(3005)) == {(0, True)} and {got[i] for i in range(3005, 3009)} == {(None, False)} and len(got) == 3009


def test_a_crowded_spot_is_never_paired(spark):
    """A third of all points at places of their own within a cell, and dense clumps of which some come just into reach."""
    from geoloom.operators import dbscan as m
    from geoloom.operators.joins import chord

    rng = random.Random(4)
    east = lambda meters: 20 + math.degrees(meters / 6371008.8) / math.cos(math.radians(10))
    clump = lambda at, n, wide: [(10 + rng.random() * wide, east(at) + rng.random() * wide) for _ in range(n)]
    at = clump(0, 900, 5e-5)
    # Clumps 3 m wide whose nearest points are a little less, and a little more, than 30 m apart; then loose points.
    at += [(10.01 + rng.random() * 2e-5, east(-rng.random() * 3)) for _ in range(150)] + [(10.01, 20.0)]
    at += [(10.01 + rng.random() * 2e-5, east(29.999 + rng.random() * 3)) for _ in range(150)] + [(10.01, east(29.999))]
    at += [(10.01, east(29.999 + 3.0 + 30.01 + rng.random() * 3)) for _ in range(150)]
    at += [(10 + rng.random() * 0.004, east(rng.random() * 400)) for _ in range(400)]
    n = len(at)
    near = [[j for j in range(n) if abs(at[i][0] - at[j][0]) < 3e-4 and _meters(at[i], at[j]) <= 30.0] for i in range(n)]
    for least in (4, 60):
        core_ = [len(x) >= least for x in near]
        label: dict[int, int] = {}
        for i in range(n):
            todo = [i] if core_[i] and i not in label else []
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += [j for j in near[k] if core_[j]]
        for i in range(n):
            if not core_[i] and (found := [(_meters(at[i], at[j]), at[j], label[j]) for j in near[i] if core_[j]]):
                label[i] = min(found)[2]
        first = sorted({min(k for k in label if label[k] == c): c for c in set(label.values())}.items())
        number = {c: k for k, (_, c) in enumerate(first)}
        frame = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "idx long, lat double, lon double")
        got = {r.idx: (r.cluster_id, r.is_core) for r in dbscan(frame, 30.0, least).collect()}
        assert got == {i: (number[label[i]] if i in label else None, core_[i]) for i in range(n)}
    edge = chord(30.0) / 3**0.5 * (1 - 1e-4)
    spots = m._spots(frame, edge, 4)
    rows = m._near(spots, 30.0, edge, chord(30.0) * (1 + 1e-9) / edge).count()
    assert rows < 20 * spots.where("NOT full").count() < sum(map(len, near)) / 10


def test_middles_of_zones(spark):
    from geoloom.functions.grids import utm_central_meridian

    rows = spark.range(0, 62).select("id", utm_central_meridian("id").alias("m")).collect()
    assert [r.m for r in rows] == [None, *[-177.0 + 6 * k for k in range(60)], None]


def test_what_an_expected_grid_says_of_a_text_that_is_none(spark):
    from geoloom.sources.detect import parse_coordinate

    texts = ["u09tvw0f6szy", "nothing here", "48.5, 2.25", "geo:91,0", None]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.p for r in frame.select("k", parse_coordinate(F.col("t"), "geohash").alias("p")).orderBy("k").collect()]
    assert got[0].how == "geohash" and got[2].how == "text" and got[4] is None
    assert got[1].error_kind and got[3].error_kind and [p and p.error_detail for p in got] == [None, "not a geohash reference", None, None, None]
    plain = frame.where("k = 1").select(parse_coordinate(F.col("t")).alias("p")).first().p
    assert plain.error_kind and plain.error_detail is None
