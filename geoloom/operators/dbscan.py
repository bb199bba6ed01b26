"""Density clustering as joins of grid cells: crowded cells are counted and linked whole, and only sparse ones meet point by point."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geodesy import haversine, unit_vector
from geoloom.operators.aggregates import dense_number
from geoloom.operators.joins import chord
from geoloom.operators.tables import counted, written

#: Two sets of cores of which one has at most so many meet point by point; larger ones are cut into 4 ** 3 parts each.
_FEW = 32
#: Neighbours of a cell whose diagonal is the radius.
_STEPS = list(product((-2, -1, 0, 1, 2), repeat=3))
_AXES = ("x", "y", "z")
#: Cells along each edge of a tile. Rows travel by tile, and look into neighbouring cells where they have arrived.
_TILE = 32
#: What a position is known by.
_LOOSE = ("lat", "lon", "idx", "x", "y", "z", "cell")
#: Both sides of a join by tile and cell may stay as they were dealt by tile.
_BY_TILE = "spark.sql.requireAllClusterKeysForCoPartition"


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of each vertex of ``edges(a, b)``, as (id, component).

    Every vertex has a pointer to a vertex of its component that is not larger. A round takes the least pointer's pointer among the
    neighbours of each vertex and gives it to the vertex and to what it points at, so that whole trees are hooked at once and chains
    shorten by halves. This ends when no pointer changes: then neighbours have one pointer. Each round is written out; only a count of
    changes reaches the driver.
    """
    links = written(edges.union(edges.select("b", "a")).distinct())
    labels = written(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("f")))
    while True:
        held = written(labels.join(labels.select(F.col("id").alias("f"), F.col("f").alias("g")), "f"))
        low = links.join(held, links["b"] == held["id"]).groupBy(F.col("a").alias("id")).agg(F.min("g").alias("low"))
        best = held.join(low, "id").select("id", "f", F.least("g", "low").alias("m"))
        both = best.select("id", "m", F.col("f").alias("was")).unionByName(best.select(F.col("f").alias("id"), "m", F.lit(None).cast("long").alias("was")))
        now, n = counted(both.groupBy("id").agg(F.min("m").alias("f"), F.max("was").alias("was")), changed=F.count_if(F.expr("f != was")))
        labels = now.select("id", "f")
        if not n["changed"]:
            return labels.withColumnRenamed("f", "component")


def _steps(which: list[tuple[int, int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(k).alias(a) for k, a in zip(o, _AXES)]) for o in which]))


def _moved(cell: str, step: str) -> Column:
    return F.struct(*[(F.col(f"{cell}.{a}") + F.col(f"{step}.{a}")).alias(a) for a in _AXES])


def _tile(cell: str) -> Column:
    return F.struct(*[F.floor(F.col(f"{cell}.{a}") / _TILE).alias(a) for a in _AXES])


def _tiles_near(cell: str) -> Column:
    """A row for each tile that has a neighbour of the cell, or the cell itself."""
    ends = product((-2, 2), repeat=3)
    return F.explode(F.array_distinct(F.array(*[F.struct(*[F.floor((F.col(f"{cell}.{a}") + k) / _TILE).alias(a) for k, a in zip(o, _AXES)]) for o in ends])))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile")


@contextmanager
def _kept_by_tile(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile joins rows as they were dealt by tile."""
    before = spark.conf.get(_BY_TILE, None)
    spark.conf.set(_BY_TILE, "false")
    try:
        yield
    finally:
        spark.conf.unset(_BY_TILE) if before is None else spark.conf.set(_BY_TILE, before)


def _square(x: Column) -> Column:
    return F.pow(x, F.lit(2.0))


def _on_sphere(cell: str, edge: float) -> Column:
    """Whether the unit sphere passes the cell, with a margin for rounding."""
    near = far = F.lit(0.0)
    for a in _AXES:
        lo, hi = F.col(f"{cell}.{a}") * edge, (F.col(f"{cell}.{a}") + 1) * edge
        near = near + _square(F.greatest(lo, -hi, F.lit(0.0)))
        far = far + _square(F.greatest(F.abs(lo), F.abs(hi)))
    return (near <= 1 + 1e-9) & (far >= 1 - 1e-9)


def _within(level: int) -> Column:
    """A point's cell at ``level``, of which each is cut into 4 ** 3 at the next."""
    return F.struct(*[F.floor(F.col(a) * 4.0**level).alias(a) for a in _AXES])


def _spots(points: DataFrame, edge: float, min_points: int) -> DataFrame:
    """Distinct positions with their number and earliest idx, place in units of ``edge``, cell, and whether the cell is full.

    All points of a full cell are cores: it has ``min_points``, and none is further from another than the radius.
    """
    spots = points.groupBy("lat", "lon").agg(F.min("idx").alias("idx"), F.count("*").alias("n"))
    place = unit_vector(F.col("lat"), F.col("lon"))
    spots = spots.select("*", *[(v / edge).alias(a) for v, a in zip(place, _AXES)]).where(" AND ".join(f"NOT isnan({a})" for a in _AXES))
    spots = spots.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("cell", _within(0))
    held = spots.groupBy("cell").agg((F.sum("n") >= min_points).alias("full"))
    return written(spots.join(held, "cell"))


def _met(loose: DataFrame, spots: DataFrame, eps_m: float, edge: float, reach: float) -> DataFrame:
    """``loose`` (its tile, lat, lon, idx, x, y, z and cell) with each of ``spots`` (qlat, qlon, n, full) within ``eps_m``: d and the latter's cell as ``there``."""
    # A row looks into 125 cells, so rows are dealt out by tile first, and each tile's other side goes there once.
    loose = _dealt(loose.select(*_LOOSE, _tile("cell").alias("tile")))
    there = _dealt(spots.select(F.col("cell").alias("there"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), "n", "full", _tiles_near("cell").alias("tile")))
    seek = loose.withColumn("step", _steps(_STEPS)).withColumn("there", _moved("cell", "step")).drop("step")
    gap = F.lit(0.0)
    for a in _AXES:
        gap = gap + _square(F.greatest(F.col(f"there.{a}") - F.col(a), F.col(a) - F.col(f"there.{a}") - 1, F.lit(0.0)))
    met = seek.where((gap <= reach * reach) & _on_sphere("there", edge)).join(there, ["tile", "there"])
    return met.withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon"))).where(F.col("d") <= eps_m)


def _around(spots: DataFrame, eps_m: float, edge: float, reach: float) -> DataFrame:
    """The positions of cells that are not full, with the number of points within ``eps_m`` as n."""
    rows = _met(spots.where("NOT full"), spots, eps_m, edge, reach).groupBy("tile", *_LOOSE).agg(F.sum("n").alias("n"))
    with _kept_by_tile(spots.sparkSession):
        return written(rows.drop("tile"))


def _near(spots: DataFrame, eps_m: float, edge: float, reach: float, of: DataFrame | None = None) -> DataFrame:
    """What each position of a cell that is not full has within ``eps_m``: lat, lon, idx, n, m (the nearest as distance, lat, lon and
    cell), full, and qlat, qlon. Only of positions in ``of``, if that is given.

    A full cell is one row, whatever it holds, and another cell has fewer than ``min_points``; so a position has a bounded number of rows.
    """
    met = _met(spots.where("NOT full") if of is None else of, spots, eps_m, edge, reach)
    alone = lambda c: F.when(~F.col("full"), F.col(c)).alias(f"_{c}")
    nearest = F.min(F.struct("d", "qlat", "qlon", F.col("there").alias("cell")))
    rows = met.groupBy("tile", "lat", "lon", "idx", "there", "full", alone("qlat"), alone("qlon")).agg(F.sum("n").alias("n"), nearest.alias("m"))
    with _kept_by_tile(spots.sparkSession):
        return written(rows.select("lat", "lon", "idx", "full", F.col("_qlat").alias("qlat"), F.col("_qlon").alias("qlon"), "n", "m"))


def _nodes(core: DataFrame, level: int) -> DataFrame:
    """The cores' cells at ``level`` with their home cell, the cell above, number of positions, box and earliest position."""
    above = F.first(_within(level - 1)) if level else F.first("cell")
    return core.groupBy(_within(level).alias("sub")).agg(
        F.first("cell").alias("home"), above.alias("above"), F.count("*").alias("n"), F.min(F.struct("idx", "lat", "lon")).alias("rep"),
        *[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias(a) for a in _AXES],
    )


def _judged(pairs: DataFrame, eps_m: float, edge: float, reach: float, level: int) -> DataFrame:
    """Pairs of nodes with their kind: met if their earliest cores are near; few or many if that is open; others are left out."""
    gap = F.lit(0.0)
    for a in _AXES:
        gap = gap + _square(F.greatest(F.col(f"a_{a}.lo") - F.col(f"b_{a}.hi"), F.col(f"b_{a}.lo") - F.col(f"a_{a}.hi"), F.lit(0.0)))
    near = haversine(F.col("a_rep.lat"), F.col("a_rep.lon"), F.col("b_rep.lat"), F.col("b_rep.lon")) <= eps_m
    few = (F.least("a_n", "b_n") <= _FEW) | F.lit(edge / 4.0**level < 1e-12)
    kind = F.when(near, F.lit("met")).when(F.greatest("a_n", "b_n") == 1, F.lit("apart")).when(few, F.lit("few")).otherwise(F.lit("many"))
    return pairs.where(gap <= reach * reach).withColumn("kind", kind).where("kind != 'apart'")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of 0 to n - 1 that each reaches over the edges ``a`` to ``b``."""
    root = np.arange(n)
    while True:
        low, now = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _in_tile(rows: pa.Table) -> pa.Table:
    """A tile's pairs (a, b, kind, and whether b is of the tile) as its own nodes with their root in the tile (kind own), roots with nodes
    of other tiles that they reach (cross), and the open pairs whose roots differ. The sphere passes some 2,400 cells of a tile at most."""
    a, b, kind, here = (rows.column(k).to_numpy() for k in ("a", "b", "kind", "here"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, met = at[: len(a)], at[len(a) :], kind == "met"
    root = _roots(len(ids), a[met], b[met])
    own = np.zeros(len(ids), bool)
    own[a], own[b[here.astype(bool)]] = True, True
    cross = ~own & (np.bincount(root, minlength=len(ids))[root] > 1)
    left = ~met & (root[a] != root[b])
    parts = [(ids[own], ids[root[own]], ["own"] * int(own.sum())), (ids[root[cross]], ids[cross], ["cross"] * int(cross.sum())), (ids[a[left]], ids[b[left]], kind[left].tolist())]
    return pa.table({"a": np.concatenate([p[0] for p in parts]), "b": np.concatenate([p[1] for p in parts]), "kind": pa.array(sum((p[2] for p in parts), []), pa.string())})


def _linked(core: DataFrame, eps_m: float, edge: float, reach: float) -> tuple[DataFrame, DataFrame]:
    """The cores' cells with a root each (cell, root), and links (a, b) between the roots: a pair of cores within ``eps_m`` links their cells.

    Two cells are linked if their earliest cores are near, and not if their boxes are apart. Each tile joins what is so linked within
    it, and a pair that this leaves open is passed over if it has one root. The other pairs are settled by all
    cores of both where one has at most ``_FEW``; otherwise both are cut and their parts judged alike, until parts are some micrometres
    wide. So a crowded cell's cores meet at most ``_FEW`` of any other cell's.
    """
    level = 0
    nodes = written(_nodes(core, 0))
    side = lambda k: nodes.select(*[F.col(c).alias(f"{k}_{c}") for c in nodes.columns])
    ahead = _dealt(side("a").withColumn("tile", _tile("a_sub"))).withColumn("step", _steps([o for o in _STEPS if o > (0, 0, 0)])).withColumn("b_sub", _moved("a_sub", "step"))
    pairs = ahead.where(_on_sphere("b_sub", edge)).join(_dealt(side("b").withColumn("tile", _tiles_near("b_sub"))), ["tile", "b_sub"])
    judged = _judged(pairs, eps_m, edge, reach, 0).select("tile", F.col("a_rep.idx").alias("a"), F.col("b_rep.idx").alias("b"), "kind", (_tile("b_sub") == F.col("tile")).alias("here"))
    settled = judged.groupBy("tile").applyInArrow(_in_tile, "a long, b long, kind string")
    with _kept_by_tile(core.sparkSession):
        settled, left = counted(settled, few=F.count_if(F.expr("kind = 'few'")), many=F.count_if(F.expr("kind = 'many'")))
    own = settled.where("kind = 'own'").select(F.col("a").alias("id"), F.col("b").alias("root"))
    homes = written(nodes.select(F.col("rep.idx").alias("id"), F.col("sub").alias("cell")).join(own, "id", "left").select("id", "cell", F.coalesce("root", "id").alias("root")))
    links = settled.where("kind = 'cross'").join(homes.select(F.col("id").alias("b"), "root"), "b").select("a", F.col("root").alias("b"))
    found, rest = [], settled.where("kind IN ('few', 'many')")
    if left["few"] or left["many"]:
        for k in "ab":
            rest = rest.join(homes.select(F.col("id").alias(k), F.col("cell").alias(f"{k}_sub"), F.col("cell").alias(f"{k}_home")), k)
        rest = written(rest.drop("a", "b"))
    while left["few"] or left["many"]:
        if left["few"]:
            at = lambda k, lv=level: core.select(_within(lv).alias(f"{k}_sub"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
            both = rest.where("kind = 'few'").join(at("a"), "a_sub").join(at("b"), "b_sub")
            both = both.where(haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= eps_m)
            found.append(written(both.select("a_home", "b_home").distinct()))
        if not left["many"]:
            break
        rest = rest.where("kind = 'many'")
        rest = written((rest.join(found[-1], ["a_home", "b_home"], "left_anti") if found else rest).select("a_sub", "b_sub"))
        cut = rest.select(F.col("a_sub").alias("sub")).union(rest.select("b_sub")).distinct()
        nodes = written(_nodes(core.join(cut, _within(level) == cut["sub"], "left_semi"), level + 1))
        level += 1
        child = lambda k: nodes.select(*[F.col(c).alias(f"{k}_{c}") for c in nodes.columns])
        up = rest.select(F.col("a_sub").alias("a_above"), F.col("b_sub").alias("b_above"))
        pairs = _judged(up.join(child("a"), "a_above").join(child("b"), "b_above"), eps_m, edge, reach, level)
        judged, left = counted(pairs.select("a_sub", "b_sub", "a_home", "b_home", "kind"), few=F.count_if(F.expr("kind = 'few'")), many=F.count_if(F.expr("kind = 'many'")))
        found.append(judged.where("kind = 'met'").select("a_home", "b_home").distinct())
        rest = judged.where("kind != 'met'").join(found[-1], ["a_home", "b_home"], "left_anti")
    for more in found:
        root = lambda k: homes.select(F.col("cell").alias(f"{k}_home"), F.col("root").alias(k))
        links = links.unionByName(more.join(root("a"), "a_home").join(root("b"), "b_home").select("a", "b"))
    return homes.select("cell", "root"), links.where("a != b").distinct()


def _labelled(p: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "cluster_id", "is_core")
    met = p.join(found, (p["lat"] == found["_lat"]) & (p["lon"] == found["_lon"]), "left")
    return met.select("idx", "cluster_id", F.coalesce("is_core", F.lit(False)).alias("is_core"))


def dbscan(points: DataFrame, eps_m: float, min_points: int, idx: str = "idx") -> DataFrame:
    """Clusters of dense points: idx, cluster_id (null: noise), is_core.

    points: idx bigint, each once, lat, lon; a null or NaN position is noise. A point with ``min_points`` within ``eps_m`` (itself
    counted, the limit included) is a core; cores in reach of each other are one cluster; another point joins its nearest core's
    cluster, ties to the lower latitude and then longitude. Clusters are numbered from 0 by their earliest member. With a
    radius of 0 equal positions are a cluster; one between that and a tenth of a millimetre, and no ``min_points``, are errors.

    Cells of the unit cube have the radius as diagonal, so a cell with ``min_points`` holds nothing but cores of one cluster. The points
    of other cells, fewer than ``min_points`` each, look around themselves; crowded cells never look at each other point by point.
    """
    p = points.select(F.col(idx).alias("idx"), "lat", "lon")
    if not 0 <= eps_m < float("inf") or 0 < eps_m < 1e-4:
        raise ValueError("eps_m must be 0 or a finite number from 1e-4")
    if min_points < 1:
        raise ValueError("min_points must be at least 1")
    if eps_m == 0:
        held = p.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").groupBy("lat", "lon").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
        return _labelled(p, dense_number(held.where(F.col("n") >= min_points), "first", "cluster_id").withColumn("is_core", F.lit(True)))
    edge = chord(eps_m) / 3**0.5 * (1 - 1e-4)
    reach = (chord(eps_m) * (1 + 1e-9) + 1e-12) / edge
    spots = _spots(p, edge, min_points)
    around = _around(spots, eps_m, edge, reach)
    core = spots.where("full").select(*_LOOSE).unionByName(around.where(F.col("n") >= min_points).select(*_LOOSE))
    # A position that is no core has fewer than min_points around it.
    near = _near(spots, eps_m, edge, reach, around.where(F.col("n") < min_points))
    homes, links = _linked(core, eps_m, edge, reach)
    of = written(homes.join(components(links).withColumnRenamed("id", "root"), "root", "left").select("cell", F.coalesce("component", "root").alias("component")))
    known = core.select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    border = near.where("full").select("lat", "lon", "idx", "m").unionByName(near.where("NOT full").join(known, ["qlat", "qlon"], "left_semi").select("lat", "lon", "idx", "m"))
    border = border.groupBy("lat", "lon", "idx").agg(F.min("m").alias("m")).select("lat", "lon", "idx", F.col("m.cell").alias("cell"), F.lit(False).alias("is_core"))
    members = core.select("lat", "lon", "idx", "cell", F.lit(True).alias("is_core")).unionByName(border).join(of, "cell")
    members = written(members.select("lat", "lon", "idx", "component", "is_core"))
    ids = dense_number(members.groupBy("component").agg(F.min("idx").alias("first")), "first", "cluster_id").select("component", "cluster_id")
    return _labelled(p, members.join(ids, "component"))
