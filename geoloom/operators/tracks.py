"""As-of placement of events on tracks, stay points, trips and exclusion zones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geodesic
from geoloom.functions.core import finite_struct, let
from geoloom.functions.geodesy import SPHERE_M, along_track_spherical, box_contains, cross_track_spherical, haversine, unit_vector
from geoloom.operators.aggregates import summarize
from geoloom.operators.tables import written


def _us(x: Column) -> Column:
    """Whole microseconds of a timestamp with or without a time zone."""
    return F.unix_micros(x.cast("timestamp"))


def clean_track(fixes: DataFrame, track: str = "track_id", ts: str = "ts", idx: str = "idx") -> DataFrame:
    """Timed fixes of each track, one for each instant: the first in input order stays.

    Fixes of one instant at different positions contradict each other; the column ``conflict`` says so for that instant.
    """
    w = W.partitionBy(track, ts)
    return (
        fixes.where(F.col(ts).isNotNull())
        .withColumn("_nth", F.row_number().over(w.orderBy(idx)))
        .withColumn("conflict", (F.min("lat").over(w) != F.max("lat").over(w)) | (F.min("lon").over(w) != F.max("lon").over(w)))
        .where("_nth = 1")
        .drop("_nth")
    )


def _beside(fixes: DataFrame, asked: DataFrame, chunk_s: float) -> DataFrame:
    """``asked`` (track_id, t, any others) with the track's last fix up to t as ``a`` and its first one from t on as ``b``.

    fixes: track_id, fix (struct whose first field is t, microseconds; distinct in a track). Both are cut into chunks of time, which
    are windows of their own; what lies before and after a chunk comes from each chunk's first and last fix, so no
    task holds a track. A null track is a track.
    """
    size = int(chunk_s * 1_000_000)
    kind = fixes.schema["fix"].dataType.simpleString()
    own = [k for k in asked.columns if k not in ("track_id", "t")]
    rows = fixes.select("track_id", F.col("fix.t").alias("t"), "fix", F.lit(None).cast(asked.select(F.struct(*own)).schema[0].dataType).alias("event"))
    rows = rows.unionByName(asked.select("track_id", "t", F.lit(None).cast(kind).alias("fix"), F.struct(*own).alias("event"))).withColumn("chunk", F.floor(F.col("t") / size))
    ends = rows.groupBy("track_id", "chunk").agg(F.min("fix").alias("first"), F.max("fix").alias("last"))
    upto, since = W.partitionBy("track_id").orderBy("chunk"), W.partitionBy("track_id").orderBy(F.col("chunk").desc())
    ends = ends.select(
        F.col("track_id").alias("_track"), F.col("chunk").alias("_chunk"), F.last("last", ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.last("first", ignorenulls=True).over(since.rowsBetween(W.unboundedPreceding, -1)).alias("after"),
    )
    w = W.partitionBy("track_id", "chunk")
    rows = (
        rows.withColumn("a", F.last("fix", ignorenulls=True).over(w.orderBy("t").rangeBetween(W.unboundedPreceding, 0)))
        .withColumn("b", F.last("fix", ignorenulls=True).over(w.orderBy(F.col("t").desc()).rangeBetween(W.unboundedPreceding, 0)))
        .where("event IS NOT NULL")
    )
    met = rows.join(ends, rows["track_id"].eqNullSafe(ends["_track"]) & (rows["chunk"] == ends["_chunk"]))
    return met.select("track_id", "t", *[F.col(f"event.{k}").alias(k) for k in own], F.coalesce("a", "before").alias("a"), F.coalesce("b", "after").alias("b"))


def asof_locate(tracks: DataFrame, events: DataFrame, max_gap_s: float = 1800.0, max_hold_s: float = 0.0, offset_ms: int = 0, chunk_s: float = 86_400.0) -> DataFrame:
    """Place events on tracks by time: event_id, lat, lon, how (matched, interpolated, held or null).

    tracks: track_id, ts, lat, lon with distinct times; events: event_id, track_id, ts; events without a time are left out. An exact
    instant matches; between two fixes no more than ``max_gap_s`` apart the position lies on the great circle; else the nearer side is held if it is
    within ``max_hold_s``, the earlier of equals; else the position is null. Time is compared in whole microseconds and looked
    at in chunks of ``chunk_s``.
    """
    fixes = tracks.select("track_id", F.struct(_us(F.col("ts")).alias("t"), "lat", "lon").alias("fix")).where("fix.t IS NOT NULL")
    asked = events.select("track_id", (_us(F.col("ts")) + offset_ms * 1000).alias("t"), "event_id").where("t IS NOT NULL")
    both = _beside(fixes, asked, chunk_s)
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    to_a, to_b = t - a["t"], b["t"] - t
    between = great_circle(a["lat"], a["lon"], b["lat"], b["lon"], to_a / (b["t"] - a["t"]))
    point = lambda f, how: F.struct(f["lat"].alias("lat"), f["lon"].alias("lon"), F.lit(how).alias("how"))
    hold_us = F.lit(int(max_hold_s * 1_000_000))
    at = (
        F.when(a["t"] == t, point(a, "matched"))
        .when(a.isNotNull() & b.isNotNull() & (b["t"] - a["t"] <= int(max_gap_s * 1_000_000)), point(between, "interpolated"))
        .when(a.isNotNull() & (to_a <= hold_us) & (b.isNull() | (to_a <= to_b)), point(a, "held"))
        .when(b.isNotNull() & (to_b <= hold_us), point(b, "held"))
    )
    return both.withColumn("at", at).select("event_id", "at.lat", "at.lon", "at.how")


def locate_fixes(
    tracks: DataFrame, events: DataFrame, max_gap_s: float = 1800.0, max_hold_s: float = 0.0, offset_ms: int = 0, max_speed_mps: float = 50.0, nearest: bool = False, chunk_s: float = 86_400.0
) -> DataFrame:
    """Fixes of events from tracks, with how far off they may be and where they come from.

    tracks: track_id, ts, lat, lon, and where there are such columns accuracy_m, accuracy_kind (``bound``, or another: no guarantee),
    height_m, height_kind, ambiguity; cleaned by :func:`clean_track` (give it idx). events: event_id, track_id, ts.
    Returns event_id, t_us (the event's time with the offset), how (matched, interpolated, nearest, extrapolated or null), lat, lon,
    height_m, height_kind, accuracy_m, accuracy_kind (bound, unspecified), source, ambiguity, notes.

    Between two fixes no more than ``max_gap_s`` apart the place lies on the geodesic, or is the nearer fix's, the earlier of equals, with
    ``nearest``; heights of one kind are drawn straight between. Outside, the nearer fix within ``max_hold_s`` is kept. Each fix that is used
    reaches as far as its own accuracy, the speed times the time away, and the distance to the place; the smallest reach
    is the accuracy, and it is a bound if all fixes used have a bound of their own.
    """
    if not (0 <= max_speed_mps < float("inf")):
        raise ValueError("max_speed_mps must be finite and not negative")
    of = lambda k, kind: (F.col(k) if k in tracks.columns else F.lit(None)).cast(kind).alias(k)
    extra = [of("accuracy_m", "double"), of("accuracy_kind", "string"), of("height_m", "double"), of("height_kind", "string"), of("ambiguity", "string")]
    timed = clean_track(tracks) if "idx" in tracks.columns else tracks
    fixes = timed.select("track_id", F.struct(_us(F.col("ts")).alias("t"), "lat", "lon", *extra).alias("fix")).where("fix.t IS NOT NULL")
    asked = events.select("track_id", (_us(F.col("ts")) + offset_ms * 1000).alias("t"), "event_id").where("t IS NOT NULL")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    hold, gap = F.lit(int(max_hold_s * 1_000_000)), F.lit(int(max_gap_s * 1_000_000))
    how = (
        F.when(a["t"] == t, "matched").when(a.isNotNull() & b.isNotNull() & (b["t"] - a["t"] <= gap), "nearest" if nearest else "interpolated")
        .when(a.isNotNull() & (t - a["t"] <= hold) & (b.isNull() | (t - a["t"] <= b["t"] - t)), "extrapolated").when(b.isNotNull() & (b["t"] - t <= hold), "extrapolated")
    )
    rows = _beside(fixes, asked, chunk_s).withColumn("how", how)
    later = ((F.col("how") == "nearest") & (b["t"] - t < t - a["t"])) | ((F.col("how") == "extrapolated") & (a.isNull() | (t - a["t"] > hold) | (b["t"] - t < t - a["t"])))
    rows = rows.withColumn("f", F.when(F.col("how").isNotNull(), F.when(F.coalesce(later, F.lit(False)), b).otherwise(a)))
    drawn, two = F.col("how") == "interpolated", F.col("how").isin("interpolated", "nearest")
    share = F.when(drawn, F.try_divide(t - a["t"], b["t"] - a["t"]))
    middle = geodesic.intermediate(a["lat"], a["lon"], b["lat"], b["lon"], share)
    rows = rows.withColumn("share", share).withColumn("middle", middle)
    f = F.col("f")
    rows = rows.withColumn("lat", F.when(drawn, F.col("middle.lat")).otherwise(f["lat"])).withColumn("lon", F.when(drawn, F.col("middle.lon")).otherwise(f["lon"]))
    # Distances from the fixes used; one that is the place itself is at none.
    for k, x in (("a", a), ("b", b)):
        rows = rows.withColumn(f"{k}_m", F.when(two, geodesic.geodesic_distance(x["lat"], x["lon"], F.when(two, F.col("lat")), F.when(two, F.col("lon")))).otherwise(0.0))
    reach = lambda x, m: F.coalesce(x["accuracy_m"], F.lit(0.0)) + F.abs(t - x["t"]) / 1e6 * max_speed_mps + m
    sure = lambda x: F.coalesce((x["accuracy_kind"] == "bound") & x["accuracy_m"].isNotNull(), F.lit(False))
    same = a["height_kind"].isNotNull() & (a["height_kind"] == b["height_kind"]) & a["height_m"].isNotNull() & b["height_m"].isNotNull()
    height = F.when(drawn, F.when(same, a["height_m"] + (b["height_m"] - a["height_m"]) * F.col("share"))).otherwise(f["height_m"])
    s = lambda x: x["t"] / 1e6
    source = (
        F.when(F.col("how") == "matched", F.format_string("geotag:matched t=%.3f", s(f)))
        .when(drawn, F.format_string("geotag:interpolated t0=%.3f t1=%.3f f=%.3f", s(a), s(b), F.col("share")))
        .when(F.col("how") == "nearest", F.format_string("geotag:nearest t=%.3f t0=%.3f t1=%.3f", s(f), s(a), s(b)))
        .when(F.col("how") == "extrapolated", F.format_string("geotag:extrapolated t=%.3f dt=%.3f", s(f), (t - f["t"]) / 1e6))
    )
    note = F.lit(f"clock offset of {offset_ms:+} ms applied to the photo time" if offset_ms else None).cast("string")
    return rows.select(
        "event_id", F.when(F.col("how").isNotNull(), t).alias("t_us"), "how", "lat", "lon", height.alias("height_m"),
        F.when(height.isNotNull(), F.when(drawn, a["height_kind"]).otherwise(f["height_kind"])).alias("height_kind"),
        F.when(two, F.least(reach(a, F.col("a_m")), reach(b, F.col("b_m")))).otherwise(reach(f, F.lit(0.0))).alias("accuracy_m"),
        F.when(F.col("how").isNotNull(), F.when(F.when(two, sure(a) & sure(b)).otherwise(sure(f)), "bound").otherwise("unspecified")).alias("accuracy_kind"),
        source.alias("source"), F.when(two, F.coalesce(a["ambiguity"], b["ambiguity"])).otherwise(f["ambiguity"]).alias("ambiguity"), F.when(F.col("how").isNotNull(), note).alias("notes"),
    )


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, fraction: Column) -> Column:
    """(lat, lon) at a fraction of the great circle between two points; the first one where they are the same."""

    def weighed(g: Column) -> Column:
        part = lambda share: F.sin(g["arc"] * share) / F.sin(g["arc"])
        return let(F.struct(part(F.lit(1.0) - g["share"]).alias("p"), part(g["share"]).alias("q")), lambda w: let(vector(w), point))

    def vector(w: Column) -> Column:
        a, b = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
        return F.struct(*[(u * w["p"] + v * w["q"]).alias(k) for u, v, k in zip(a, b, "xyz")])

    point = lambda v: F.struct(F.degrees(F.atan2(v["z"], F.hypot(v["x"], v["y"]))).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lon"))
    start = F.struct((haversine(lat1, lon1, lat2, lon2) / SPHERE_M).alias("arc"), fraction.alias("share"))
    return let(start, lambda g: F.when(g["arc"] < 1e-15, F.struct(lat1.alias("lat"), lon1.alias("lon"))).otherwise(weighed(g)))


def segment_trips(visits: DataFrame, gap_s: float, keys: list[str], idx: str = "idx") -> DataFrame:
    """Trips of visits (arrival, departure timestamps): a visit that begins more than ``gap_s`` after everything before it
    opens a trip. Returns keys, trip (from 0), n_visits, start, end."""
    w = W.partitionBy(*keys).orderBy("arrival", idx)
    until = F.max("departure").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = (until.isNull() | (_us(F.col("arrival")) - _us(until) > int(gap_s * 1_000_000))).cast("int")
    return (
        visits.withColumn("opens", opens)
        .withColumn("trip", F.sum("opens").over(w) - 1)
        .groupBy(*keys, "trip")
        .agg(F.count("*").alias("n_visits"), F.min("arrival").alias("start"), F.max("departure").alias("end"))
    )


def _apart(lat1: float, lon1: float, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Metres on the mean sphere; angles in radians."""
    h = np.clip(np.sin((lat - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat) * np.sin((lon - lon1) / 2) ** 2, 0.0, 1.0)
    return 2 * SPHERE_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def track_stretches(fixes: DataFrame, jump_m: float) -> DataFrame:
    """``fixes`` (track_id, idx, ts, lat, lon) with ``stretch``, which changes where a track's next fix is over ``jump_m`` away, and ``mark``, ascending.

    The order is that of track, time, latitude, longitude, idx. Rows are sorted into ranges, so a long track spreads over tasks; each
    range knows its neighbour's last row, and a sum over the ranges numbers the stretches.
    """
    order = ["track_id", "t", "lat", "lon", "idx"]
    timed = fixes.where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("track_id", "idx", "ts", _us(F.col("ts")).alias("t"), "lat", "lon")
    rows = written(timed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    ends = rows.groupBy(part.alias("part")).agg(F.max_by(F.struct("track_id", "lat", "lon"), "mark").alias("end"))  # a row per range
    ends = ends.select(F.lead("part").over(W.orderBy("part")).alias("part"), F.col("end").alias("edge"))
    inside = W.partitionBy("part").orderBy("mark")
    rows = rows.withColumn("part", part).join(ends, "part", "left")
    before = F.coalesce(F.lag(F.struct("track_id", "lat", "lon")).over(inside), F.col("edge"))
    rows = rows.withColumn("before", before)
    leap = F.col("before").isNull() | ~F.col("before.track_id").eqNullSafe(F.col("track_id")) | (haversine("before.lat", "before.lon", "lat", "lon") > jump_m)
    rows = written(rows.select("track_id", "idx", "ts", "lat", "lon", "mark", "part", F.sum(leap.cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("nth")))
    sums = rows.groupBy("part").agg(F.max("nth").alias("leaps"))
    starts = sums.select("part", F.coalesce(F.sum("leaps").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return rows.join(starts, "part").select("track_id", "idx", "ts", "lat", "lon", "mark", (F.col("start") + F.col("nth")).alias("stretch"))


def visit_members(fixes: DataFrame, distance_m: float, dwell_s: float) -> DataFrame:
    """The fixes of every stay point: track_id, visit (mark of its first fix), anchor_idx, idx, ts, lat, lon.

    fixes: track_id, idx, ts, lat, lon. In the order of time, latitude, longitude and idx a run is every fix within
    ``distance_m`` of its first one; a run that lasts ``dwell_s`` is a visit and the next begins after it, else the next
    begins one fix later. Limits are inclusive; a fix without a time or position is left out; a null track is a track.

    No run reaches over a leap of twice the distance, so tracks are cut there and the stretches dealt out. A stretch is streamed in
    order: a task holds the fixes of the run that isn't yet long enough, never a stretch or a track.
    """
    if not (0 <= distance_m < float("inf")):
        raise ValueError("distance_m must be finite and not negative")
    dwell = int(dwell_s * 1_000_000)
    cut = track_stretches(fixes, 2.0 * distance_m * (1 + 1e-9) + 1e-6)
    kinds = {f.name: f.dataType.simpleString() for f in fixes.schema}

    def stays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, anchor = None, None  # anchor: lat, lon, mark, idx of a run that is a visit already
        held: list[tuple] = []  # fixes of the open run: t, lat, lon, mark, row
        for b in batches:
            taken, visit, first = [], [], []
            names = b.column(0).to_numpy(zero_copy_only=False)
            t, p, l, mark = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            idx, new = b.column(5).to_pylist(), []
            for k in range(b.num_rows):
                if names[k] != stretch:
                    stretch, anchor, held = names[k], None, []
                fix = (t[k], p[k], l[k], mark[k], idx[k])
                if anchor is not None:
                    if _apart(anchor[0], anchor[1], p[k], l[k]) <= distance_m:
                        new.append((mark[k], anchor[2], anchor[3]))
                        continue
                    anchor = None
                held.append(fix)
                if _apart(held[0][1], held[0][2], p[k], l[k]) > distance_m:
                    held = _reopened(held, distance_m)
                if t[k] - held[0][0] >= dwell:
                    anchor = (held[0][1], held[0][2], held[0][3], held[0][4])
                    new += [(f[3], anchor[2], anchor[3]) for f in held]
                    held = []
            for m, v, f in new:
                taken.append(m)
                visit.append(v)
                first.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.int64()), pa.array(visit, pa.int64()), pa.array(first, b.schema.field(5).type)], ["mark", "visit", "anchor_idx"])

    dealt = cut.select("stretch", _us(F.col("ts")).alias("t"), F.radians("lat").alias("p"), F.radians("lon").alias("l"), "mark", "idx")
    dealt = dealt.repartition("stretch").sortWithinPartitions("stretch", "mark")
    found = dealt.mapInArrow(stays, f"mark long, visit long, anchor_idx {kinds['idx']}")
    return cut.join(found, "mark").select("track_id", "visit", "anchor_idx", "idx", "ts", "lat", "lon")


def _reopened(held: list[tuple], distance_m: float) -> list[tuple]:
    """The open run once its newest fix has left its first one: from the earliest later fix that all after it are in reach of.

    Runs that end among the held fixes are no visits: the one before them lasted longer and was none.
    """
    lat, lon = np.array([f[1] for f in held]), np.array([f[2] for f in held])
    start = 1
    while start < len(held) and (_apart(lat[start], lon[start], lat[start:], lon[start:]) > distance_m).any():
        start += 1
    return held[start:]


def segment_visits(fixes: DataFrame, distance_m: float, dwell_s: float) -> DataFrame:
    """Stay points: track_id, arrival, departure, n_fixes, anchor_idx; see :func:`visit_members`."""
    return (
        visit_members(fixes, distance_m, dwell_s)
        .groupBy("visit")
        .agg(F.first("track_id").alias("track_id"), F.min("ts").alias("arrival"), F.max("ts").alias("departure"), F.count("*").alias("n_fixes"), F.first("anchor_idx").alias("anchor_idx"))
        .drop("visit")
    )


def visit_summaries(members: DataFrame) -> DataFrame:
    """Each visit of :func:`visit_members`: track_id, arrival, departure, n_fixes, anchor_idx, lat, lon, max_error_m (mean and bound), south,
    west, north, east (box)."""
    kept = written(members)
    times = kept.groupBy("visit").agg(F.first("track_id").alias("track_id"), F.min("ts").alias("arrival"), F.max("ts").alias("departure"), F.first("anchor_idx").alias("anchor_idx"))
    return times.join(summarize(kept, ["visit"]).withColumnRenamed("n", "n_fixes").drop("first_idx"), "visit").drop("visit")


def _circle_cells(zones: DataFrame, edge: float) -> DataFrame:
    """Cells (cx, cy, cz) of the unit cube that circles (lat, lon, radius_m) reach, with the circle as zlat, zlon, radius_m, and whether it holds the ``whole`` cell."""
    axes, steps = ("x", "y", "z"), F.explode(F.sequence(F.lit(-4), F.lit(4)))
    half = F.least(F.col("radius_m") / (2 * SPHERE_M), F.lit(np.pi / 2))
    cells = zones.select(F.col("lat").alias("zlat"), F.col("lon").alias("zlon"), "radius_m", (F.sin(half) * (2 / edge)).alias("reach"), *[(v / edge).alias(a) for v, a in zip(unit_vector(F.col("lat"), F.col("lon")), axes)])
    low = high = near = far = F.lit(0.0)
    for a in axes:
        cells = cells.withColumn(f"c{a}", steps).withColumn(f"c{a}", F.floor(a) + F.col(f"c{a}"))
        lo, hi = F.col(f"c{a}"), F.col(f"c{a}") + 1
        square = lambda v: F.pow(v, F.lit(2.0))
        low, high = low + square(F.greatest(lo, -hi, F.lit(0))), high + square(F.greatest(F.abs(lo), F.abs(hi)))
        near, far = near + square(F.greatest(lo - F.col(a), F.col(a) - hi, F.lit(0.0))), far + square(F.greatest(hi - F.col(a), F.col(a) - lo))
    # The sphere passes the cell and the circle comes near it, with margins for rounding.
    met = (F.sqrt(low) * edge <= 1 + 1e-9) & (F.sqrt(high) * edge >= 1 - 1e-9) & (F.sqrt(near) * edge <= F.col("reach") * edge * (1 + 1e-9) + 1e-12)
    whole = (F.sqrt(far) * edge <= F.col("reach") * edge * (1 - 1e-9) - 1e-12) & F.col("zlat").between(-90, 90)
    return cells.where(met).select("cx", "cy", "cz", "zlat", "zlon", "radius_m", whole.alias("whole"))


def zones_strip(fixes: DataFrame, zones: DataFrame, idx: str = "idx") -> DataFrame:
    """Fixes outside all circular zones (zone_id, lat, lon, radius_m); the edge belongs to a zone, a place off the globe is in none.

    Radii are grouped by powers of two, 26 at most, from the largest down; a circle has cells of at least an eighth of its radius, so 729 at
    most. A cell that some circle holds is one row and takes its fixes along, whatever the number of circles; what is left looks at
    the circles that cut its cell, until one holds it.
    """
    from geoloom.operators.joins import chord

    keys = ["cx", "cy", "cz"]
    there = F.col("lat").between(-90, 90) & ~F.isnan("lon")
    left = fixes.select("*", *[F.when(there, v).alias(f"_{a}") for v, a in zip(unit_vector(F.col("lat"), F.col("lon")), "xyz")])
    sized = zones.where("radius_m >= 0").withColumn("_power", F.least(F.ceil(F.log2(F.greatest("radius_m", F.lit(1.0)))), F.lit(25)).cast("int"))
    for power in sorted((r[0] for r in sized.select("_power").distinct().collect()), reverse=True):
        edge = (chord(float(2**power)) * (1 + 1e-9) + 1e-12) / 4
        cells = _circle_cells(sized.where(F.col("_power") == power), edge)
        # Cells are many more than the circles that the planner knows of, and are never broadcast.
        covered = cells.where("whole").select(*keys).distinct()
        parts = cells.where("NOT whole").drop("whole").join(covered.hint("merge"), keys, "left_anti")
        left = left.select("*", *[F.floor(F.col(f"_{k[1]}") / edge).alias(f"_{k}") for k in keys])
        for there in (covered, parts):
            met = (left["_cx"] == there["cx"]) & (left["_cy"] == there["cy"]) & (left["_cz"] == there["cz"])
            if there is parts:
                met = met & (haversine(left["lat"], left["lon"], there["zlat"], there["zlon"]) <= there["radius_m"])
            left = left.join(there.hint("merge"), met, "left_anti")
        left = left.drop(*[f"_{k}" for k in keys])
    return left.select(*fixes.columns)


def zones_apply(fixes: DataFrame, zones: DataFrame, precision, idx: str = "idx") -> DataFrame:
    """``fixes`` (idx, lat, lon, kind, horizontal_m and others) with those inside a zone moved to their cell's middle.

    zones: circles as for :func:`zones_strip`. Fixes outside all zones stay as they are; inside any, position, error kind and size
    follow :func:`geoloom.functions.privacy.coarsen_fix`. A column ``source`` names the cell, null outside.
    """
    from geoloom.functions.privacy import coarsen_fix

    outside = zones_strip(fixes, zones, idx).select(idx, F.lit(True).alias("_out"))
    moved = fixes.join(outside, idx, "left").withColumn("_at", F.when(F.col("_out").isNull(), coarsen_fix("lat", "lon", F.col("kind"), "horizontal_m", precision)))
    inside = F.col("_at").isNotNull()
    for k in ("lat", "lon", "kind", "horizontal_m"):
        moved = moved.withColumn(k, F.when(inside, F.col(f"_at.{k}")).otherwise(F.col(k)))
    return moved.withColumn("source", F.col("_at.source")).drop("_out", "_at")


def estimate_offset(track: DataFrame, references: DataFrame) -> DataFrame:
    """Median of how much later than a clock says a track passes the places of reference photos: track_id, offset_ms, n.

    track: track_id, ts, lat, lon; references: track_id, ts, lat, lon, few for each track (they are broadcast to its segments by an
    equi-join). A reference is passed where its track comes nearest: at a fix or beside a segment, by great circles; of equally near
    passes the one nearer to the photo's time. Each reference looks at all of its track's segments.
    """
    w = W.partitionBy("track_id").orderBy("t")
    fixes = track.select("track_id", _us(F.col("ts")).alias("t"), "lat", "lon")
    legs = fixes.select("*", *[F.lead(k).over(w).alias(f"{k}2") for k in ("t", "lat", "lon")])
    asked = references.select("track_id", F.monotonically_increasing_id().alias("ref"), _us(F.col("ts")).alias("at"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    along = along_track_spherical("rlat", "rlon", "lat", "lon", "lat2", "lon2")
    length = haversine("lat", "lon", "lat2", "lon2")
    own = F.struct(haversine("rlat", "rlon", "lat", "lon").alias("m"), F.col("t").cast("double").alias("t"))
    beside = F.when(
        (along > 0) & (along < length),
        F.struct(F.abs(cross_track_spherical("rlat", "rlon", "lat", "lon", "lat2", "lon2")).alias("m"), (F.col("t") + (F.col("t2") - F.col("t")) * (along / length)).alias("t")),
    )
    passes = asked.join(legs, "track_id").select("track_id", "ref", "at", own.alias("own"), beside.alias("beside"))
    order = lambda p: F.struct(F.round(f"{p}.m", 3).alias("m"), F.abs(F.col(f"{p}.t") - F.col("at")).alias("apart"), F.col(f"{p}.t").alias("t"))
    nearer = F.least(order("own"), F.when(F.col("beside").isNotNull(), order("beside")))
    best = passes.groupBy("track_id", "ref", "at").agg(F.min(nearer).alias("b"))
    late = (F.col("b.t") - F.col("at")) / 1000.0
    return best.groupBy("track_id").agg(F.round(F.percentile(late, F.lit(0.5))).cast("bigint").alias("offset_ms"), F.count("*").alias("n"))


def points_with_cells(points: DataFrame, meters: float) -> DataFrame:
    """Points with the cells that radius joins meet on (cx, cy, cz), to be kept as a table bucketed or sorted by them."""
    from geoloom.operators.joins import _cell, chord

    x, y, z = _cell(unit_vector(F.col("lat"), F.col("lon")), chord(meters) * (1 + 1e-9) + 1e-12)
    return points.select("*", x.alias("cx"), y.alias("cy"), z.alias("cz"))


def inside_boxes(fixes: DataFrame, boxes: DataFrame, idx: str = "idx") -> DataFrame:
    """The ``idx`` of fixes (lat, lon) inside any box zone (south, west, north, east; west > east crosses the antimeridian), each once.

    Both sides meet on cells of one degree, of which a box has 65,000 at most; a fix is in one. A cell that some box covers is one row, and only
    fixes of other cells look at boxes, until one holds them. Edges belong to a box, a pole has every longitude; a place off the globe is in no box.
    """
    at = lambda x: F.floor(x).cast("int")
    turn = lambda x: F.pmod(x + 180, F.lit(360)) - 180
    pole = F.lit(999)
    box = F.struct("south", "west", "north", "east")
    end = F.when(F.col("west") <= F.col("east"), F.col("east")).otherwise(F.col("east") + 360.0)
    columns = F.sequence(at("west"), at("west") + F.least(at(end) - at("west"), F.lit(359)))
    tall = boxes.where("south <= north").select(box.alias("box"), end.alias("end"), "south", "west", "north", F.explode(columns).alias("x"))
    cells = tall.select("*", F.explode(F.sequence(at("south"), at("north"))).alias("row"))
    whole = (F.col("south") <= F.col("row")) & (F.col("row") + 1 <= F.col("north")) & (F.col("west") <= F.col("x")) & (F.col("x") + 1 <= F.col("end"))
    cells = cells.select("box", "row", turn(F.col("x")).alias("col"), whole.alias("whole"))
    tips = F.array_compact(F.array(*[F.when(F.col(edge) == deg, F.lit(deg)) for edge, deg in (("north", 90), ("south", -90))]))
    cells = cells.unionByName(boxes.where("south <= north").select(box.alias("box"), F.explode(tips).alias("row"), pole.alias("col"), F.lit(True).alias("whole")))
    there = F.col("lat").between(-90, 90) & ((F.abs("lat") == 90.0) | F.col("lon").between(-180, 180))
    own = fixes.where(there).select(F.col(idx).alias(idx), "lat", "lon", at("lat").alias("row"), F.when(F.abs("lat") == 90.0, pole).otherwise(turn(at("lon"))).alias("col"))
    # At most 65,000 cells, whatever the number of boxes; the boxes' parts are many, and are never broadcast.
    seen = own.join(cells.groupBy("row", "col").agg(F.max("whole").alias("full")), ["row", "col"])
    covered = cells.where("whole").select("row", "col").distinct()
    parts = cells.where("NOT whole").join(covered, ["row", "col"], "left_anti").distinct().hint("merge")
    met = (seen["row"] == parts["row"]) & (seen["col"] == parts["col"]) & box_contains(parts["box"], seen["lat"], seen["lon"])
    return seen.where("full").select(idx).unionByName(seen.where("NOT full").join(parts, met, "left_semi").select(idx)).distinct()


def zone_circle(lat: Column, lon: Column, radius_m: Column) -> Column:
    """STRUCT<lat, lon, radius_m> of a circular zone; null for a place off the globe, or a negative or infinite radius."""
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), finite_struct(radius_m >= 0, lat=lat, lon=lon, radius_m=radius_m))
