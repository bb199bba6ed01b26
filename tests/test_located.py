"""Positions on tracks: accuracy, heights, sources, and chunks of time that change nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions.geodesic import geodesic_distance
from geoloom.operators.tracks import asof_locate, locate_fixes

TRACK = "track_id string, idx long, s double, lat double, lon double, accuracy_m double, accuracy_kind string, height_m double, height_kind string, ambiguity string"
FIXES = [
    ("a", 1, 1000.0, 10.0, 20.0, 5.0, "bound", 100.0, "ellipsoidal", None), ("a", 2, 1100.0, 10.01, 20.01, 3.0, "bound", 200.0, "ellipsoidal", "maybe"), ("a", 3, 1100.0, 11.0, 21.0, 1.0, "bound", None, None, None),
    ("a", 4, 9000.0, 10.02, 20.0, None, None, 300.0, "orthometric", None), ("a", 5, 9100.0, 10.03, 20.0, 2.0, "guess", 400.0, "ellipsoidal", None), (None, 6, 50.0, 1.0, 2.0, 4.0, "bound", None, None, None),
]


def _timed(spark, rows, kind):
    return spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")


def _located(spark, times: list, **options):
    asked = _timed(spark, [(k, t, s) for k, (t, s) in enumerate(times)], "event_id long, track_id string, s double")
    rows = locate_fixes(_timed(spark, FIXES, TRACK), asked, **options).collect()
    return [next((r for r in rows if r.event_id == k), None) for k in range(len(times))]


def test_each_way_of_placing(spark):
    matched, drawn, mixed, held, far, null, other, none = _located(
        spark, [("a", 1000.0), ("a", 1025.0), ("a", 9050.0), ("a", 1160.0), ("a", 5000.0), (None, 50.0), ("b", 50.0), ("a", None)], max_gap_s=200.0, max_hold_s=60.0, max_speed_mps=2.0
    )
    assert (matched.how, matched.lat, matched.lon, matched.accuracy_m, matched.accuracy_kind, matched.height_m, matched.source) == ("matched", 10.0, 20.0, 5.0, "bound", 100.0, "geotag:matched t=1000.000")
    assert (drawn.how, drawn.height_m, drawn.height_kind, drawn.accuracy_kind, drawn.ambiguity, drawn.notes) == ("interpolated", 125.0, "ellipsoidal", "bound", "maybe", None)
    assert drawn.source == "geotag:interpolated t0=1000.000 t1=1100.000 f=0.250"
    whole, part = spark.range(1).select(geodesic_distance(10.0, 20.0, 10.01, 20.01), geodesic_distance(10.0, 20.0, drawn.lat, drawn.lon)).first()
    assert part == pytest.approx(whole / 4, rel=1e-9) and drawn.accuracy_m == pytest.approx(min(5 + 2 * 25 + part, 3 + 2 * 75 + whole - part), rel=1e-9)
    assert (mixed.how, mixed.height_m, mixed.height_kind, mixed.accuracy_kind) == ("interpolated", None, None, "unspecified")
    assert (held.how, held.lat, held.accuracy_m, held.source, held.t_us) == ("extrapolated", 10.01, 3 + 2 * 60.0, "geotag:extrapolated t=1100.000 dt=60.000", 1_160_000_000)
    assert far[1:] == (None,) * 11 and other[1:] == (None,) * 11 and none is None
    assert (null.how, null.lat, null.height_m) == ("matched", 1.0, None)


def test_nearest_fixes_offsets_and_ties(spark):
    before, tie, after = _located(spark, [("a", 1048.0), ("a", 1049.0), ("a", 1050.0)], max_gap_s=200.0, max_speed_mps=0.0, nearest=True, offset_ms=1000)
    assert (before.how, before.lat, tie.lat, after.lat) == ("nearest", 10.0, 10.0, 10.01)
    assert before.notes == "clock offset of +1000 ms applied to the photo time" and before.source == "geotag:nearest t=1000.000 t0=1000.000 t1=1100.000"
    # The fix that is the place reaches 5 m; the other one must span the whole leg.
    assert before.accuracy_m == 5.0 and after.accuracy_m == 3.0 and before.height_m == 100.0
    for speed in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            _located(spark, [("a", 1.0)], max_speed_mps=speed)


def test_chunks_of_time_change_nothing(spark):
    rng = random.Random(8)
    fixes = sorted({(rng.choice("xyz"), round(rng.uniform(0, 40_000), 3)) for _ in range(300)})
    tracks = _timed(spark, [(t, s, rng.uniform(-80, 80), rng.uniform(-180, 180)) for t, s in fixes], "track_id string, s double, lat double, lon double")
    events = _timed(spark, [(k, rng.choice("xyzw"), rng.choice([round(rng.uniform(-500, 41_000), 3), fixes[k % 300][1] if k % 300 < len(fixes) else 0.0])) for k in range(400)], "event_id long, track_id string, s double")
    whole = sorted(map(str, asof_locate(tracks, events, 900.0, 300.0, chunk_s=1e9).collect()))
    for chunk in (100.0, 3600.0):
        assert sorted(map(str, asof_locate(tracks, events, 900.0, 300.0, chunk_s=chunk).collect())) == whole
    assert len(whole) == 400
