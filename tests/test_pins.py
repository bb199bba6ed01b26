"""The pin hierarchy against its definition, reads against scans, and geometry of its boxes and bounds."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geodesy
from geoloom.operators import pins as P
from tests.pin_model import pins as model


def scattered(seed: int, n: int) -> list[tuple[int, float, float]]:
    """Points near places where planar thinking breaks, at several scales, some of them more than once."""
    rng, out = random.Random(seed), []
    places = [(0.0, 180.0), (-17.0, -180.0), (90.0, 0.0), (-90.0, 0.0), (48.85, 2.35), (48.85, 2.351), (85.2, 10.0)]
    while len(out) < n:
        lat, lon = rng.choice(places)
        step = rng.choice([1e-1, 1e-3, 1e-5, 3.0])
        lat = max(-90.0, min(90.0, lat + rng.randrange(-20, 21) * step))
        lon = lon + rng.randrange(-20, 21) * step
        lon = lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon
        out.append((len(out), lat, lon))
        if rng.random() < 0.2:
            out.append((len(out), lat, lon))
    return out


def within(lat: float, lon: float, south: float, west: float, north: float, east: float) -> bool:
    arc = lambda x: west <= x <= east if west <= east else x >= west or x <= east
    return south <= lat <= north and (abs(lat) == 90 or arc(lon) or (abs(lon) == 180 and arc(-lon)))


@pytest.fixture(scope="module")
def built(spark):
    points = scattered(5, 500)
    table = spark.createDataFrame([*points, (9000, None, 1.0), (9001, 91.0, 0.0), (9002, float("nan"), 0.0), (None, 1.0, 1.0)], "idx long, lat double, lon double")
    return points, P.build_pins(table, 16.0, 256.0)


def test_every_zoom_is_that_of_the_definition(built):
    points, got = built
    want = model(points, 16.0, 256.0)
    rows = {(r.zoom, r.id): r for r in got.pins.collect()}
    leaves = [r.idx for r in sorted(got.leaves.collect(), key=lambda r: r.leaf)]
    assert len(leaves) == len(points) and sorted(leaves) == [p[0] for p in points]
    assert {k for k in rows} == {(z, i) for z in range(P.DEEPEST + 1) for i in want[z]}
    parent = {(z + 1, c): i for z in range(P.DEEPEST) for i, pin in want[z].items() for c in pin["children"]}
    for (zoom, i), r in rows.items():
        pin = want[zoom][i]
        assert leaves[r.first : r.first + r.n] == pin["points"]
        # At a pole, where no longitude is left, whole numbers of 2**-80 tell it to 1e-6 degrees.
        assert (r.lat, r.lon) == pytest.approx(pin["at"], abs=1e-9 if abs(r.lat) < 89.9999 else 1e-6)
        assert r.parent == parent.get((zoom, i))
    assert got.rounds.keys() == set(range(P.DEEPEST + 1)) and set(got.rounds.values()) == {1}


def test_boxes_and_bounds_hold_all_points(spark, built):
    points, got = built
    at = {i: (lat, lon) for i, lat, lon in points}
    leaves = {r.leaf: r.idx for r in got.leaves.collect()}
    rows = [r for r in got.pins.where("zoom in (0, 3, 9, 15, 22)").collect()]
    flat = [(r.zoom, r.id, r.south, r.west, r.north, r.east, r.lat, r.lon, r.max_error_m, *at[leaves[k]]) for r in rows for k in range(r.first, r.first + r.n)]
    t = spark.createDataFrame(flat, "zoom int, id long, south double, west double, north double, east double, clat double, clon double, bound double, lat double, lon double")
    from geoloom.functions.geodesic import geodesic_distance

    t = t.select(geodesy.box_contains(F.struct("south", "west", "north", "east"), F.col("lat"), F.col("lon")).alias("held"), (geodesic_distance("clat", "clon", "lat", "lon") <= F.col("bound")).alias("near"))
    assert t.where("NOT held OR NOT near").count() == 0 and t.count() > len(points)


def test_pins_in_boxes_children_and_pages(spark, built):
    points, got = built
    every = {(r.zoom, r.id): r for r in got.pins.collect()}
    boxes = [(-5, -40, 5, -20), (0, 150, 30, -150), (-30, -180, 30, -170), (5, 180, 15, 180), (80, -10, 90, 10), (-90, -10, -80, 10), (48, 2, 49, 3), (-85, -180, 85, 180), (-90, -180, 90, 180)]
    views = []
    for zoom in (0, 4, 12.5, 22, 30):
        for k, edges in enumerate(boxes):
            box = geodesy.box(*[float(v) for v in edges])
            views.append((f"{zoom}/{k}", *map(float, edges), float(zoom)))
            level = min(int(zoom), P.DEEPEST)
            if k % 4 == 0:
                scan = sorted(i for (z, i), r in every.items() if z == level and within(r.lat, r.lon, *edges))
                assert sorted(r.id for r in P.pins_in_view(got.pins, box, zoom).collect()) == scan
    table = spark.createDataFrame(views, "view string, south double, west double, north double, east double, zoom double")
    met: dict[str, list[int]] = {}
    for r in P.pins_in_views(got.pins, table).collect():
        met.setdefault(r.view, []).append(r.id)
    for zoom in (0, 4, 12.5, 22, 30):
        for k, edges in enumerate(boxes):
            level = min(int(zoom), P.DEEPEST)
            assert sorted(met.get(f"{zoom}/{k}", [])) == sorted(i for (z, i), r in every.items() if z == level and within(r.lat, r.lon, *edges)), (zoom, edges)
    big = max((r for r in every.values() if r.zoom == 3), key=lambda r: r.n)
    kids = P.pin_children(got, 3, big.id).collect()
    assert sum(r.n for r in kids) == big.n and all(every[(4, r.id)].parent == big.id for r in kids)
    whole = P.pin_page(got, 3, big.id, big.n)
    assert whole == [i for r in kids for i in P.pin_page(got, 4, r.id, r.n)]
    assert P.pin_page(got, 3, big.id, 5, 3) == whole[3:8] and P.pin_page(got, 3, big.id, 5, big.n) == [] and P.pin_page(got, 3, big.id, 0) == []
    asked = spark.createDataFrame([(3, big.id, 2, 4), (3, big.id, big.n - 1, 10), (3, -1, 0, 5)], "zoom int, id long, start long, size long")
    pages = sorted((r.nth, r.idx) for r in P.pin_leaves(got, asked).collect())
    assert pages == sorted([(k, whole[k]) for k in (2, 3, 4, 5)] + [(big.n - 1, whole[-1])])
    deep = max((r for r in every.values() if r.zoom == P.DEEPEST), key=lambda r: r.n)
    assert [r.id for r in P.pin_children(got, P.DEEPEST, deep.id).collect()] == P.pin_page(got, P.DEEPEST, deep.id, deep.n)
    assert P.pin_page(got, P.LEAF, points[0][0], 3) == [points[0][0]]
    with pytest.raises(ValueError):
        P.pin_page(got, 3, -1, 5)
    with pytest.raises(ValueError):
        P.pins_in_box(got.pins, geodesy.box(0.0, 0.0, 1.0, 1.0), 23)


def test_tiles_settle_like_one_row_after_another(spark, monkeypatch):
    # A chain that runs along and across the edges of tiles, each point in reach of the next.
    r = P.reach_at(9, 40.0, 512.0) * 360
    rng = random.Random(2)
    points = [(k, -0.3 + 0.002 * k, 0.9 * r * ((k * 7) % 5) + rng.random() * r) for k in range(900)]
    table = spark.createDataFrame(points, "idx long, lat double, lon double")
    nodes = P.written(P.point_nodes(table))
    most = 0
    for zoom in (9, 12):
        radius = P.reach_at(zoom, 40.0, 512.0)
        one, members, rounds = P.join_seeds(nodes, zoom, radius, len(points))
        one = {x.id: x.parent for x in one.collect()}
        assert rounds == 1 and 1 < len(set(one.values())) == len(one) - members < len(one)
        monkeypatch.setattr(P, "TILE_NODES", 0)
        for up in (5, 1):
            monkeypatch.setattr(P, "TILE_UP", up)
            got, again, rounds = P.join_seeds(nodes, zoom, radius, len(points))
            assert {x.id: x.parent for x in got.collect()} == one and again == members
            most = max(most, rounds)
        monkeypatch.undo()
    assert most > 1


def test_updates_are_rebuilds(spark, monkeypatch):
    points, rng = scattered(11, 260), random.Random(3)
    kind = "idx long, lat double, lon double"
    first, later = points[:200], [(i, lat, lon) for i, lat, lon in points[200:]] + [(700, points[3][1], points[3][2])]
    index = P.index_pins(spark.createDataFrame(first, kind), 16.0, 256.0)
    gone = {p[0] for p in rng.sample(first, 25)} | {points[3][0]}
    monkeypatch.setattr(P, "TILE_NODES", 50)
    got = P.update_pins(index, spark.createDataFrame([*later, (900, None, 1.0)], kind), spark.createDataFrame([(i,) for i in gone] + [(5555,)], "idx long"))
    monkeypatch.undo()
    want = P.index_pins(spark.createDataFrame([p for p in first if p[0] not in gone] + later, kind), 16.0, 256.0)
    for zoom in range(P.LEAF, -1, -1):
        assert sorted(map(tuple, got.nodes[zoom].select(*P._NODE).collect())) == sorted(map(tuple, want.nodes[zoom].select(*P._NODE).collect())), zoom
        if zoom < P.LEAF:
            parents = lambda t: {r.id: (r.state, r.parent) for r in t.joined[zoom].collect()}
            assert parents(got) == parents(want), zoom
    # Only what differs is written, far less than the levels hold.
    assert 0 < sum(got.rewritten.values()) < sum(t.count() for t in [*want.nodes.values(), *want.joined.values()])
    assert P.update_pins(index).rewritten == {P.LEAF: 0}


def test_options_and_empty_tables(spark):
    none = spark.createDataFrame([], "idx long, lat double, lon double")
    got = P.build_pins(none)
    assert got.pins.count() == 0 and got.leaves.count() == 0
    for radius, tile in ((0.0, 512.0), (float("nan"), 512.0), (40.0, float("inf")), (200.0, 512.0)):
        with pytest.raises(ValueError):
            P.build_pins(none, radius, tile)
    codes = spark.range(1).select(P.pin_code(F.lit(5), F.lit(7)).alias("a"), P.pin_code(F.lit(5), F.lit(1 << 33)).alias("b"))
    assert codes.first() == ((5 << 32) | 7, None)
    assert spark.range(1).select(P.pin_of_code(F.lit((5 << 32) | 7)).alias("a")).first().a == (5, 7)


def test_seeds_and_open_nodes_bring_their_places():
    """Later rounds read them from what was found: an open node behind one beyond the edge, a seed, and a member, which needs none."""
    names = ["tile", "own", "id", "klon", "x", "y", "state", "klat"]
    rows = [(0, False, 1, 5.0, 0.1, 0.1, P.OPEN, 4.0), (0, True, 2, 6.0, 0.1005, 0.1, P.OPEN, 4.5), (0, True, 3, 7.0, 0.3, 0.3, P.OPEN, 5.0), (0, True, 4, 8.0, 0.3005, 0.3, P.OPEN, 5.5)]
    (found,) = P.settle(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])]), 0.001)
    assert [tuple(r[k] for k in ("id", "state", "klat", "klon", "x", "y")) for r in found.to_pylist()][:2] == [(2, P.OPEN, 4.5, 6.0, 0.1005, 0.1), (3, P.SEED, 5.0, 7.0, 0.3, 0.3)]
    assert found.to_pylist()[2] == {"id": 4, "state": P.MEMBER, "parent": 3, "plon": 7.0, "klat": None, "klon": None, "x": None, "y": None}
