"""Stay points and their members against brute force: long tracks, ties, missing values, and batches that end within a run."""

from __future__ import annotations

import random
from math import atan2, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from geoloom.operators.tracks import segment_visits, track_stretches, visit_members, visit_summaries

KIND = "track_id string, idx long, s long, lat double, lon double"


def meters(a: tuple, b: tuple) -> float:
    p, q = radians(a[0]), radians(b[0])
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * atan2(sqrt(h), sqrt(1 - h))


def stays(rows: list[tuple], distance: float, dwell: float) -> set[tuple]:
    out = set()
    for track in {r[0] for r in rows}:
        own = sorted(r[2:] + (r[1],) for r in rows if r[0] == track and None not in r[2:])
        i = 0
        while i < len(own):
            j = i + 1
            while j < len(own) and meters(own[i][1:3], own[j][1:3]) <= distance:
                j += 1
            if own[j - 1][0] - own[i][0] >= dwell:
                out |= {(track, own[i][3], f[3]) for f in own[i:j]}
                i = j
            else:
                i += 1
    return out


def walk(seed: int, n: int, track: str | None, leap: float) -> list[tuple]:
    """A walk of small steps with pauses, and now and then a leap."""
    rng, lat, lon, t, out = random.Random(seed), 10.0, 179.999, 0, []
    for k in range(n):
        step = rng.choice([0, 0, 1e-4, 5e-4, 2e-3]) if rng.random() > leap else 0.5
        lat, lon, t = lat + step * rng.uniform(-1, 1), lon + step * rng.uniform(-1, 1), t + rng.choice([0, 5, 30, 120])
        lon = lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon
        out.append((track, k + seed * 10_000, t, lat, lon))
    return out


@pytest.mark.parametrize("distance,dwell", [(150.0, 300.0), (60.0, 0.0), (0.0, 60.0), (400.0, 1200.0)])
def test_visits_are_those_of_brute_force(spark, distance, dwell):
    rows = walk(1, 700, "a", 0.02) + walk(2, 150, "b", 0.0) + walk(3, 60, None, 0.2) + [("c", 1, 5, 1.0, 1.0), ("c", 2, None, 1.0, 1.0), ("c", 3, 400, None, 1.0), ("c", 4, 400, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_seconds("s"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.track_id, r.anchor_idx, r.idx) for r in visit_members(frame, distance, dwell).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == stays(rows, distance, dwell) and got


def test_a_long_track_is_cut_at_leaps_and_summaries_hold_their_fixes(spark):
    rows = walk(4, 3000, "hot", 0.03)
    frame = spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_seconds("s"))
    cut = track_stretches(frame, 300.0).collect()
    assert len({r.stretch for r in cut}) == 1 + sum(meters(a[3:], b[3:]) > 300.0 for a, b in zip(*[sorted(rows, key=lambda r: (r[2], r[3], r[4], r[1]))[k:] for k in (0, 1)]))
    members = stays(rows, 150.0, 300.0)
    visits = visit_summaries(visit_members(frame, 150.0, 300.0)).collect()
    at = {r[1]: r[3:] for r in rows}
    assert sum(v.n_fixes for v in visits) == len(members) and {v.anchor_idx for v in visits} == {a for _, a, _ in members}
    for v in visits:
        own = [at[i] for _, a, i in members if a == v.anchor_idx]
        assert all(v.south <= lat <= v.north and meters((lat, lon), (v.lat, v.lon)) <= v.max_error_m * 1.01 + 1e-3 for lat, lon in own)
    times = {r.anchor_idx: (r.arrival, r.departure, r.n_fixes) for r in segment_visits(frame, 150.0, 300.0).collect()}
    assert times == {v.anchor_idx: (v.arrival, v.departure, v.n_fixes) for v in visits}


def test_no_fixes_and_wrong_distances(spark):
    none = spark.createDataFrame([], KIND).withColumn("ts", F.timestamp_seconds("s"))
    assert segment_visits(none, 100.0, 60.0).count() == 0
    for distance in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            visit_members(none, distance, 60.0)
