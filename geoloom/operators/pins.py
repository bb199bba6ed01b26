"""A hierarchy of map pins: for every zoom from 22 to 0 the pins of the next zoom, merged within a fixed number of pixels.

Nodes are ordered by their first point's latitude, longitude and idx. At each zoom a node is a seed if no earlier seed lies within
reach on the Web Mercator square, and joins the earliest such seed otherwise; the seeds are the lexicographically first maximal
independent set, which depends on nothing but the nodes and their order.

Every zoom is settled in tiles of the map. A tile's task streams its own nodes and those just outside, in order, and holds only
seeds, which no more than a bounded number fit into a tile, and nodes that are still open. A node is open while an earlier open node
lies in reach and no earlier seed does; nodes beyond a tile's edge are open until their own tile says otherwise. Rounds over the
tiles that have open nodes repeat until none is left; the earliest open node is always settled, and a chain of nodes costs a
round only where it crosses an edge. Points at one position are a node with a count, so a crowded spot is counted, not paired.

Sums of unit vectors are whole numbers of 2**-80, so that a pin's sum is that of its points in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.core import WGS84
from geoloom.functions.geodesy import ELLIPSOIDS, box_contains
from geoloom.functions.mercator import unit_x, unit_y
from geoloom.operators.aggregates import surface_normal
from geoloom.operators.tables import counted, written

#: The deepest zoom of pins; points are one level below.
DEEPEST = 22
LEAF = DEEPEST + 1
#: A zoom's tiles are those of the map this many zooms above it, and fewer for points, as any number of those fit into a tile. Up to
#: TILE_NODES nodes are one tile in any case.
TILE_UP, TILE_UP_POINTS, TILE_NODES = 5, 3, 100_000
#: Unit vectors are whole numbers of this part; a mean shorter than DEGENERATE has no direction; metres added for rounding.
UNIT, DEGENERATE, ROUND_OFF_M = 2.0**80, 1e-9, 1e-6
#: What is known of a node at a zoom: nothing, a seed, a member of a seed, a member whose seed isn't certain yet.
OPEN, SEED, MEMBER, WAITING = 0, 1, 2, 3

_KEY = ["klat", "klon", "id"]
_NODE = [*_KEY, "x", "y", "n", "sx", "sy", "sz", "lat", "lon", "err", "south", "west", "north", "east"]


class Pins(NamedTuple):
    """pins: zoom, id (idx of the first point), n, lat, lon, max_error_m, south, west, north, east, parent (id at the zoom
    above, null at zoom 0), first (number of its first leaf). leaves: idx, lat, lon, pin (id at zoom 22), leaf (0, 1, ... depth first,
    so that the leaves of a pin are ``first`` to ``first + n - 1``). rounds: zoom to rounds over tiles."""

    pins: DataFrame
    leaves: DataFrame
    rounds: dict[int, int]


class PinIndex(NamedTuple):
    """A hierarchy that can be updated. points: idx, lat, lon. nodes: by zoom (LEAF: positions); joined: by zoom what
    :func:`join_seeds` found of the nodes below. rounds: over tiles, by zoom. rewritten: rows that the last update wrote, by zoom."""

    points: DataFrame
    nodes: dict[int, DataFrame]
    joined: dict[int, DataFrame]
    rounds: dict[int, int]
    radius_px: float
    tile_px: float
    crs: str
    rewritten: dict[int, int]


def reach_at(zoom: int, radius_px: float, tile_px: float) -> float:
    """The merge radius at a zoom, as a part of the world's width."""
    return radius_px / tile_px / 2.0**zoom


def _number(x: Column) -> Column:
    return (x * UNIT).cast("decimal(25,0)")


def placed(points: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, lat, lon) of the rows that have an idx and a position on the globe; there is no negative zero."""
    on_globe = F.col(idx).isNotNull() & F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0)
    return points.where(on_globe).select(F.col(idx).cast("long").alias("idx"), (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))


def point_nodes(points: DataFrame, idx: str = "idx") -> DataFrame:
    """A node for each different position of ``points`` (idx, lat, lon), named by its smallest idx."""
    lat, lon = F.col("lat"), F.col("lon")
    at = placed(points, idx).groupBy("lat", "lon").agg(F.min("idx").alias("id"), F.count("*").alias("n"))
    count = F.col("n").cast("decimal(12,0)")
    sums = [(_number(v) * count).cast("decimal(38,0)").alias(f"s{k}") for k, v in zip("xyz", surface_normal(lat, lon))]
    meridian = F.when(F.abs(lat) < 90.0, lon)  # a pole has none
    return at.select(
        lat.alias("klat"), lon.alias("klon"), "id", unit_x(lon).alias("x"), unit_y(lat).alias("y"), "n", *sums, "lat", "lon", F.lit(0.0).alias("err"),
        lat.alias("south"), meridian.alias("west"), lat.alias("north"), meridian.alias("east"),
    )


def _tiles(zoom: int, up: int, radius: float) -> Column:
    """Array of (tile, own): a node's tile, and the tiles whose edge it may reach across."""
    across = 1 << max(0, zoom - up)
    side = 1.0 / across
    near = radius * (1 + 1e-9) + 1e-15
    column, row = (F.least(F.floor(F.col(k) / side), F.lit(across - 1)) for k in "xy")
    if across == 1:
        return F.array(F.struct(F.lit(0).cast("long").alias("tile"), F.lit(True).alias("own")))
    dx, dy = F.col("x") - column * side, F.col("y") - row * side
    places = [
        F.when(
            (F.lit(True) if not i else dx <= near if i < 0 else dx >= side - near) & (F.lit(True) if not j else (dy <= near) & (row > 0) if j < 0 else (dy >= side - near) & (row < across - 1)),
            F.struct((F.pmod(column + i, F.lit(across)) * across + row + j).cast("long").alias("tile"), F.lit(not i and not j).alias("own")),
        )
        for i in (0, -1, 1)
        for j in (0, -1, 1)
    ]
    # With two columns both neighbours are one tile; a node visits it once.
    return F.array_distinct(F.array_compact(F.array(*places)))


def settle(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """Nodes (tile, own, id, klon, x, y, state, klat), by tile and order, to what is found of a tile's own unsettled nodes: id, state, parent, plon.

    Seeds and nodes that are still open come with their klat, klon, x and y, so that later rounds need no join to have them.
    """
    columns = max(1, min(int(1.0 / radius), 1 << 31))
    around = sorted({-1 % columns, 0, 1 % columns})
    square, tile = radius * radius, None
    seeds: dict[tuple[int, int], list] = {}
    opens: dict[tuple[int, int], list] = {}
    for b in batches:
        out: tuple[list, ...] = [], [], [], [], []
        rows = zip(*(b.column(k).to_pylist() for k in range(7)))
        for nth, (at, own, name, klon, x, y, state) in enumerate(rows):
            if at != tile:
                tile, order = at, 0
                seeds.clear()
                opens.clear()
            order += 1
            cx, cy = min(int(x * columns), columns - 1), min(int(y * columns), columns - 1)
            if state == SEED:
                seeds.setdefault((cx, cy), []).append((order, x, y, name, klon))
                continue
            best, blocked = None, None
            for i in around:
                for j in (-1, 0, 1):
                    cell = ((cx + i) % columns, cy + j)
                    for s in seeds.get(cell, ()):
                        if best is None or s[0] < best[0]:
                            dx, dy = abs(s[1] - x), s[2] - y
                            if dx > 0.5:
                                dx = 1.0 - dx
                            if dx * dx + dy * dy <= square:
                                best = s
                    for o in opens.get(cell, ()):
                        if blocked is None or o[0] < blocked:
                            dx, dy = abs(o[1] - x), o[2] - y
                            if dx > 0.5:
                                dx = 1.0 - dx
                            if dx * dx + dy * dy <= square:
                                blocked = o[0]
            if best is not None:
                # It is no seed, so it blocks nobody; which seed it joins is certain if no open node before that one is in reach.
                found = (MEMBER, best[3], best[4]) if blocked is None or blocked > best[0] else (WAITING, None, None)
            elif blocked is None and own:
                found = SEED, name, klon
                seeds.setdefault((cx, cy), []).append((order, x, y, name, klon))
            else:
                found = OPEN, None, None
                opens.setdefault((cx, cy), []).append((order, x, y))
            if own:
                for column, value in zip(out, (name, *found, None if found[0] == MEMBER else nth)):
                    column.append(value)
        place = pa.array(out[4], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))), *(b.column(k).take(place) for k in (7, 3, 4, 5))],
            ["id", "state", "parent", "plon", "klat", "klon", "x", "y"],
        )


def join_seeds(nodes: DataFrame, zoom: int, radius: float, size: int, known: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """Each node's seed at ``zoom`` as (id, state, parent, plon); how many are no seeds; the number of rounds.

    nodes: a level's ``size`` nodes, a written table. known: settled nodes (id, state, parent, plon) that stay as they are; nodes
    beyond them are settled around them, and only those are counted.
    """
    up = LEAF if size <= TILE_NODES else TILE_UP_POINTS if zoom == DEEPEST else TILE_UP
    at = nodes.select(*_KEY, "x", "y")
    rest, settled, seeds, members, rounds = at.withColumn("state", F.lit(OPEN)), [], None, 0, 0
    if known is not None:
        rest, settled = rest.join(known.select("id"), "id", "left_anti").select(*rest.columns), [known]
        seeds = at.join(known.where(F.col("state") == SEED).select("id"), "id", "left_semi").withColumn("state", F.lit(SEED))
    tally = lambda *states: F.count_if(F.col("state").isin(*states))
    while True:
        rounds += 1
        dealt = rest.select("*", F.explode(_tiles(zoom, up, radius)).alias("t")).select(*rest.columns, "t.*")
        if seeds is not None:
            there = dealt.where("own").select("tile").distinct()
            beside = seeds.select("*", F.explode(_tiles(zoom, up, radius)).alias("t")).select(*seeds.columns, "t.*")
            dealt = dealt.unionByName(beside.join(there, "tile", "left_semi").select(*dealt.columns))
        dealt = dealt.repartition("tile").sortWithinPartitions("tile", *_KEY).select("tile", "own", "id", "klon", "x", "y", "state", "klat")
        what = "id long, state int, parent long, plon double, klat double, klon double, x double, y double"
        found, n = counted(dealt.mapInArrow(lambda b: settle(b, radius), what), open=tally(OPEN, WAITING), members=tally(MEMBER))
        members += n["members"]
        settled.append(found.where(F.col("state").isin(SEED, MEMBER)) if n["open"] else found)
        if not n["open"]:
            break
        rest, new = (found.where(F.col("state").isin(*k)).select(*at.columns, "state") for k in ([OPEN, WAITING], [SEED]))
        seeds = new if seeds is None else seeds.unionByName(new)
    whole = settled[0].select("id", "state", "parent", "plon")
    for more in settled[1:]:
        whole = whole.unionByName(more.select("id", "state", "parent", "plon"))
    return whole, members, rounds


def _from(meridian: Column, lon: Column) -> Column:
    """Degrees east of a meridian, from -180 up to 180."""
    return F.pmod(lon - meridian + 180.0, F.lit(360.0)) - 180.0


def merged(nodes: DataFrame, joined: DataFrame, zoom: int, crs: str = WGS84) -> DataFrame:
    """The pins of a zoom from the nodes below and what :func:`join_seeds` found of them.

    A pin of one node is that node. Others: the mean direction of all points (that of the first node where they cancel); the bound
    is the furthest node's distance and its own bound, and a millionth of a metre; the box holds the nodes' boxes, grown from
    the first point's meridian both ways. All are sums, minima and maxima, combined before the shuffle, so a pin may have any number of nodes.
    """
    e = ELLIPSOIDS[crs]
    below = nodes.join(joined.select("id", "parent", "plon"), "id")
    west = _from(F.col("plon"), F.col("west"))
    span = F.when(F.col("west") > F.col("east"), F.col("east") - F.col("west") + 360.0).otherwise(F.col("east") - F.col("west"))
    own = F.when(F.col("id") == F.col("parent"), F.struct("klat", "klon", "lat", "lon", "err"))
    sums = below.groupBy("parent").agg(
        F.max(own).alias("o"), F.count("*").alias("nodes"), F.sum("n").alias("n"), *[F.sum(k).cast("decimal(38,0)").alias(k) for k in ("sx", "sy", "sz")],
        F.min("south").alias("south"), F.max("north").alias("north"),
        F.min(F.when(F.col("west").isNotNull(), F.struct(west.alias("off"), "west"))).alias("w"),
        F.max(F.when(F.col("west").isNotNull(), F.struct((west + span).alias("off"), "east"))).alias("e"),
        (F.lit(None) if zoom == DEEPEST else F.collect_list(F.struct(*[x.alias(k) for k, x in zip("xyz", surface_normal(F.col("lat"), F.col("lon")))], "err"))).alias("parts"),
    )
    v = {k: F.col(f"s{k}").cast("double") for k in "xyz"}
    size = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    lone = F.col("nodes") == 1
    cancel = lone | (size < F.col("n") * (DEGENERATE * UNIT))
    # Points at one position have it for their mean, but for rounding.
    lone_err = F.col("o.err") + (F.when(F.col("n") > 1, F.lit(ROUND_OFF_M)).otherwise(0.0) if zoom == DEEPEST else 0.0)
    lat = F.when(cancel, F.col("o.lat")).otherwise(F.degrees(F.atan2(v["z"], F.hypot(v["x"], v["y"]))))
    lon = F.when(cancel, F.col("o.lon")).otherwise(F.degrees(F.atan2(v["y"], v["x"])))
    whole = F.col("e.off") - F.col("w.off") >= 360.0
    pins = sums.select(
        F.col("parent").alias("id"), "o.klat", "o.klon", lone.alias("lone"), lone_err.alias("own_err"), "parts", "n", "sx", "sy", "sz", lat.alias("lat"), lon.alias("lon"),
        "south", F.when(whole, F.lit(-180.0)).otherwise(F.col("w.west")).alias("west"), "north", F.when(whole, F.lit(180.0)).otherwise(F.col("e.east")).alias("east"),
    )
    if zoom == DEEPEST:  # any number of positions may join a seed, so they meet its centre by a join
        middle = pins.where(~F.col("lone")).select(F.col("id").alias("parent"), *[x.alias(f"m{k}") for k, x in zip("xyz", surface_normal(F.col("lat"), F.col("lon")))])
        far = F.max(_angle([F.col(f"m{k}") for k in "xyz"], surface_normal(F.col("lat"), F.col("lon"))) * (e.a * e.a / e.b) + F.col("err"))
        out = pins.drop("parts").join(below.join(middle, "parent").groupBy(F.col("parent").alias("id")).agg(far.alias("reach")), "id", "left")
    else:  # a reach holds only so many seeds of the zoom below
        apart = lambda m: F.array_max(F.transform("parts", lambda p: _angle([m[k] for k in "xyz"], [p[k] for k in "xyz"]) * (e.a * e.a / e.b) + p["err"]))
        centre = F.struct(*[x.alias(k) for k, x in zip("xyz", surface_normal(F.col("lat"), F.col("lon")))])
        out = pins.withColumn("reach", F.when(~F.col("lone"), F.get(F.transform(F.array(centre), apart), 0)))
    return out.select(
        *_KEY, unit_x("lon").alias("x"), unit_y("lat").alias("y"), "n", "sx", "sy", "sz", "lat", "lon",
        F.when(F.col("lone"), F.col("own_err")).otherwise(F.col("reach") + ROUND_OFF_M).alias("err"), "south", "west", "north", "east",
    )


def _angle(a, b) -> Column:
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return F.atan2(F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])


def _check(radius_px: float, tile_px: float) -> None:
    if not (0 < radius_px < float("inf") and 0 < tile_px < float("inf")):
        raise ValueError("radius_px and tile_px must be finite and positive")
    if radius_px > tile_px / 4:
        raise ValueError("radius_px is at most a quarter of tile_px")


def index_pins(points: DataFrame, radius_px: float = 40.0, tile_px: float = 512.0, idx: str = "idx", crs: str = WGS84) -> PinIndex:
    """The levels of :func:`build_pins`, to be published or updated. Every level is a written table."""
    _check(radius_px, tile_px)
    points = placed(points, idx)
    first, n = counted(point_nodes(points), size=F.count("*"))
    nodes, joined, rounds, size = {LEAF: first}, {}, {}, n["size"]
    for zoom in range(DEEPEST, -1, -1):
        below = nodes[zoom + 1]
        joined[zoom], members, rounds[zoom] = join_seeds(below, zoom, reach_at(zoom, radius_px, tile_px), size)
        # Where nobody joins, the pins are the nodes; positions may still be of several points.
        nodes[zoom] = written(merged(below, joined[zoom], zoom, crs)) if members or zoom == DEEPEST else below
        size -= members
    return PinIndex(points, nodes, joined, rounds, radius_px, tile_px, crs, {})


def _numbered(nodes: dict[int, DataFrame], joined: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """(id, parent, first) by zoom: each pin's first leaf in depth-first order, from zoom 0 down.

    A zoom's siblings are few, since only so many seeds fit into a pin's reach; all pins of zoom 0 are siblings.
    """
    order = W.partitionBy("parent").orderBy(*_KEY).rowsBetween(W.unboundedPreceding, -1)
    out: dict[int, DataFrame] = {}
    for zoom in range(DEEPEST + 1):
        here = nodes[zoom].select(*_KEY, "n")
        here = here.join(joined[zoom - 1].select("id", "parent"), "id") if zoom else here.withColumn("parent", F.lit(None).cast("long"))
        here = here.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        if zoom:
            above = out[zoom - 1].select(F.col("id").alias("parent"), F.col("first").alias("_first"))
            here = here.join(above, "parent").withColumn("before", F.col("before") + F.col("_first"))
        here = here.select("id", "parent", F.col("before").cast("long").alias("first"))
        out[zoom] = written(here) if zoom % 4 == 3 or zoom == DEEPEST else here
    return out


def build_pins(points: DataFrame, radius_px: float = 40.0, tile_px: float = 512.0, idx: str = "idx", crs: str = WGS84) -> Pins:
    """The whole hierarchy over ``points`` (idx long, lat, lon; other columns are ignored).

    radius_px: pixels within which pins merge, at most a quarter of tile_px, the width of a map tile. Rows without an idx or a position on
    the globe have no pin. Latitudes beyond the map's edge are cut to it, longitudes wrap; over a pole nothing merges. Repeated idx are
    points of their own. An empty table gives empty tables. ``pins`` is written by zoom, so a zoom's pins are read
    alone; ``leaves`` is written in ranges of ``leaf``, so that a page of leaves is a range of few files.
    """
    return published(index_pins(points, radius_px, tile_px, idx, crs))


def published(index: PinIndex) -> Pins:
    """The tables that maps read, from an index."""
    nodes, joined = index.nodes, index.joined
    numbers, levels = _numbered(nodes, joined), None
    for zoom in range(DEEPEST + 1):
        one = nodes[zoom].join(numbers[zoom], "id").select(
            F.lit(zoom).alias("zoom"), "id", "n", "lat", "lon", F.col("err").alias("max_error_m"), "south", F.coalesce("west", F.lit(0.0)).alias("west"), "north",
            F.coalesce("east", F.lit(0.0)).alias("east"), "parent", "first",
        )
        levels = one if levels is None else levels.unionByName(one)
    pins = written(levels, "zoom")
    # Equal positions share a pin; leaves are numbered in the order of their pin's first leaf, then position, then idx.
    homes = nodes[LEAF].select("lat", "lon", "id").join(joined[DEEPEST].select("id", F.col("parent").alias("pin")), "id").drop("id")
    homes = homes.join(numbers[DEEPEST].select(F.col("id").alias("pin"), "first"), "pin")
    order = ["first", "lat", "lon", "idx"]
    ranged = index.points.join(homes, ["lat", "lon"]).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mark", F.monotonically_increasing_id())
    ranged = written(ranged.select("idx", "lat", "lon", "pin", "mark"))
    part = F.shiftright("mark", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row per partition
    starts = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    leaves = ranged.withColumn("part", part).join(starts, "part").select("idx", "lat", "lon", "pin", (F.col("start") + nth).alias("leaf"))
    return Pins(pins, written(leaves.repartitionByRange("leaf").sortWithinPartitions("leaf")), index.rounds)


def _changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose content differs, by id: id, o and n (structs; null where there is no such row)."""
    columns = new.columns
    o, n = old.select("id", F.struct(*columns).alias("o")), new.select("id", F.struct(*columns).alias("n"))
    return o.join(n, "id", "full").where(~F.col("o").eqNullSafe(F.col("n")))


def _patched(table: DataFrame, changes: DataFrame) -> DataFrame:
    return table.join(changes.select("id"), "id", "left_anti").select(*table.columns).unionByName(changes.where("n IS NOT NULL").select("n.*"))


def update_pins(index: PinIndex, added: DataFrame | None = None, removed: DataFrame | None = None) -> PinIndex:
    """The index after taking out all points whose idx is in ``removed`` (idx) and putting in ``added`` (idx, lat, lon).

    Equal to an index of the points that are then there. At each zoom the tiles around changed nodes are settled anew with all others
    held; if a seed appears or goes near a tile's edge, the tile beyond is taken in as well, until nothing crosses an edge. Then the pins
    that gained, lost or hold a changed node are merged anew, and those that came out different are the next zoom's changed nodes.
    Only rows that differ are written, as layers over the tables before; ``rewritten`` has their number. Other rows are
    scanned, not shuffled. After many updates build the index anew.
    """
    none = index.points.limit(0)
    add = written(placed(added) if added is not None else none)
    out = written((removed if removed is not None else none).select(F.col("idx").cast("long").alias("idx")).where("idx IS NOT NULL").distinct())
    spots = written(index.points.join(out, "idx", "left_semi").unionByName(add).select("lat", "lon").distinct())
    points = index.points.join(out, "idx", "left_anti").select("idx", "lat", "lon").unionByName(add)
    nodes, joined, rounds, rewritten = dict(index.nodes), dict(index.joined), dict(index.rounds), {}
    level = index.nodes[LEAF]
    diffs, n = counted(_changes(level.join(spots, ["lat", "lon"], "left_semi").select(*_NODE), point_nodes(points.join(spots, ["lat", "lon"], "left_semi"))), rows=F.count("*"))
    nodes[LEAF], rewritten[LEAF] = _patched(level, diffs), n["rows"]
    for zoom in range(DEEPEST, -1, -1):
        if not n["rows"]:
            break
        radius = reach_at(zoom, index.radius_px, index.tile_px)
        tiles = F.explode(_tiles(zoom, TILE_UP_POINTS, radius)).alias("t")
        moved = diffs.select(F.explode(F.array_compact(F.array("o", "n"))).alias("d")).select("d.x", "d.y")
        dirty = written(moved.select(tiles).select("t.tile").distinct())
        while True:
            near, size = counted(
                nodes[zoom + 1].select(*_KEY, "x", "y", tiles).select(*_KEY, "x", "y", "t.*").join(dirty, "tile", "left_semi").groupBy(*_KEY, "x", "y").agg(F.max("own").alias("own")), rows=F.count("*")
            )
            inside = near.where("own").select("id")
            held = index.joined[zoom].join(near.where(~F.col("own")).select("id"), "id", "left_semi")
            found, _, rounds[zoom] = join_seeds(near, zoom, radius, size["rows"], written(held))
            old = index.joined[zoom].join(inside.unionByName(diffs.select("id")).distinct(), "id", "left_semi")
            flips, f = counted(_changes(old.select(*found.columns), found.join(inside, "id", "left_semi").select(*found.columns)), rows=F.count("*"))
            turned = flips.where(~F.coalesce(F.col("o.state"), F.lit(MEMBER)).eqNullSafe(F.coalesce(F.col("n.state"), F.lit(MEMBER))))
            wider = near.join(turned.select("id"), "id", "left_semi").select(tiles).select("t.tile").distinct().join(dirty, "tile", "left_anti")
            wider, w = counted(wider, rows=F.count("*"))
            if not w["rows"]:
                break
            dirty = written(dirty.unionByName(wider))
        joined[zoom] = _patched(index.joined[zoom], flips)
        parents = flips.select(F.explode(F.array_compact(F.array("o.parent", "n.parent"))).alias("parent"))
        parents = written(parents.unionByName(joined[zoom].join(diffs.select("id"), "id", "left_semi").select("parent")).distinct())
        kids = joined[zoom].join(parents, "parent", "left_semi").select("id", "state", "parent", "plon")
        old = index.nodes[zoom].join(parents.select(F.col("parent").alias("id")), "id", "left_semi")
        diffs, n = counted(_changes(old.select(*_NODE), merged(nodes[zoom + 1], kids, zoom, index.crs).select(*_NODE)), rows=F.count("*"))
        nodes[zoom], rewritten[zoom] = _patched(index.nodes[zoom], diffs), f["rows"] + n["rows"]
    return PinIndex(points, nodes, joined, rounds, index.radius_px, index.tile_px, index.crs, rewritten)


def pin_code(zoom: Column, id: Column) -> Column:
    """One number for a pin: the zoom above the 32 bits of its id; null for an id or a zoom out of range."""
    return F.when(id.between(0, (1 << 32) - 1) & zoom.between(0, LEAF), F.shiftleft(zoom.cast("long"), 32).bitwiseOR(id.cast("long")))


def pin_of_code(code: Column) -> Column:
    """(zoom, id) of a :func:`pin_code`; null where its zoom is out of range."""
    zoom = F.shiftright(code, 32)
    return F.when(zoom.between(0, LEAF), F.struct(zoom.cast("int").alias("zoom"), code.bitwiseAND(F.lit((1 << 32) - 1)).alias("id")))


def pins_in_box(pins: DataFrame, box: Column, zoom: int) -> DataFrame:
    """The pins of a zoom whose centre lies in a box, edges included. Only that zoom's files are read."""
    if not 0 <= zoom <= DEEPEST:
        raise ValueError(f"zoom {zoom} is not from 0 to {DEEPEST}")
    return pins.where((F.col("zoom") == zoom) & box_contains(box, "lat", "lon"))


def pins_in_view(pins: DataFrame, box: Column, zoom: float) -> DataFrame:
    """The pins that a map at a fractional zoom draws in a box: those of the zoom below it, no deeper than DEEPEST."""
    if not 0 <= zoom <= 30:
        raise ValueError(f"zoom {zoom} is not from 0 to 30")
    return pins_in_box(pins, box, min(int(zoom), DEEPEST))


def pins_in_views(pins: DataFrame, views: DataFrame) -> DataFrame:
    """:func:`pins_in_view` for a table of views (view, south, west, north, east, zoom): view and the pins' columns.

    A view is cut into at most about 4096 cells of the map, and pins meet views by cell. Both count as half-open tiles of a depth that
    goes by the view's size, no deeper than two above its zoom.
    """
    box = F.struct("south", "west", "north", "east")
    wide = F.when(F.col("west") > F.col("east"), F.col("east") - F.col("west") + 360.0).otherwise(F.col("east") - F.col("west")) / 360.0
    level = F.least(F.floor("zoom"), F.lit(DEEPEST)).cast("int")
    # Written once, as every use below would compute the view's edges anew.
    views = written(views.where(F.col("zoom").between(0, 30)).select("view", "south", "west", "north", "east", "zoom"))
    v = views.select("view", level.alias("zoom"), box.alias("box"), unit_x("west").alias("x"), wide.alias("w"), unit_y("north").alias("top"), unit_y("south").alias("low"))
    depth = F.floor(F.log2(F.lit(60.0) / F.greatest("w", F.col("low") - F.col("top"), F.lit(1e-9))))
    v = written(v.withColumn("depth", F.greatest(F.least(depth, F.col("zoom") - 2), F.lit(0)).cast("int")))
    side = F.pow(F.lit(2.0), F.col("depth")).cast("long")
    cut = lambda u: F.least(F.floor(u * side), side - 1)
    # A pole has every longitude, so a box there looks at all columns; 180 is -180, so others look one column further at both ends.
    all_ = (F.col("box.north") == 90.0) | (F.col("box.south") == -90.0) | ((F.col("w") + 2.0 / side) >= 1.0)
    first = F.floor(F.col("x") * side)
    v = v.select(
        "view", "zoom", "depth", "box", F.sequence(F.when(all_, F.lit(0).cast("long")).otherwise(first - 1), F.when(all_, side - 1).otherwise(F.floor((F.col("x") + F.col("w")) * side) + 1)).alias("xs"),
        F.sequence(cut(F.col("top")), cut(F.col("low"))).alias("ys"),
    )
    v = v.withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys")).select("view", "zoom", "depth", "box", F.pmod(F.col("cx"), side).alias("cx"), "cy").distinct()
    depths = v.select("zoom", "depth").distinct()  # no more rows than zooms times depths
    p = pins.join(F.broadcast(depths), "zoom").withColumn("cx", cut(unit_x("lon"))).withColumn("cy", cut(unit_y("lat")))
    return v.join(p, ["zoom", "depth", "cx", "cy"]).where(box_contains(F.col("box"), "lat", "lon")).select("view", *pins.columns)


def pin_children(pins: Pins, zoom: int, id: int) -> DataFrame:
    """What a pin is made of, in order: pins of the next zoom, or points below DEEPEST; zoom, id, n, lat, lon. Nothing for a pin that isn't there."""
    if zoom >= DEEPEST:
        points = pins.leaves.where((F.col("pin") == id) & F.lit(zoom == DEEPEST))
        return points.select(F.lit(LEAF).alias("zoom"), F.col("idx").alias("id"), F.lit(1).cast("long").alias("n"), "lat", "lon", F.col("leaf").alias("first")).orderBy("first").drop("first")
    return pins.pins.where((F.col("zoom") == zoom + 1) & (F.col("parent") == id)).orderBy("first").select("zoom", "id", "n", "lat", "lon")


def pin_leaves(pins: Pins, asked: DataFrame) -> DataFrame:
    """Pages of pins' points: for each row of ``asked`` (zoom, id, start, size) the points numbered start to start + size - 1 of the pin.

    Returns zoom, id, nth (from 0 in the pin), idx. Each page is a range of ``leaf``; ranges meet leaves by blocks of leaf numbers, so
    a page costs its own points and two blocks, not its pin's. Pins that aren't there have none.
    """
    block = 4096
    found = asked.join(pins.pins.select("zoom", "id", "n", "first"), ["zoom", "id"])
    found = found.select(
        "zoom", "id", "first", (F.col("first") + F.greatest("start", F.lit(0))).alias("lo"), (F.col("first") + F.least(F.col("start") + F.col("size"), F.col("n"))).alias("hi")
    ).where("lo < hi")
    ranges = found.select("*", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("block"))
    leaves = pins.leaves.select("idx", "leaf", F.floor(F.col("leaf") / block).alias("block"))
    met = ranges.join(leaves, "block").where((F.col("leaf") >= F.col("lo")) & (F.col("leaf") < F.col("hi")))
    return met.select("zoom", "id", (F.col("leaf") - F.col("first")).alias("nth"), "idx")


def pin_page(pins: Pins, zoom: int, id: int, limit: int, offset: int = 0) -> list[int]:
    """Up to ``limit`` of a pin's points from the ``offset``-th on, depth first: two range reads."""
    if zoom == LEAF:
        return [id][offset : offset + limit] if limit > 0 and not pins.leaves.where(F.col("idx") == id).isEmpty() else []
    pin = pins.pins.where((F.col("zoom") == zoom) & (F.col("id") == id)).select("first", "n").first()
    if pin is None:
        raise ValueError(f"no pin has zoom {zoom} and id {id}")
    lo, hi = pin["first"] + offset, pin["first"] + min(offset + limit, pin["n"])
    return [r.idx for r in pins.leaves.where((F.col("leaf") >= lo) & (F.col("leaf") < hi)).orderBy("leaf").select("idx").collect()]
