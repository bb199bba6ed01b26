"""Snapping positions to grid cells and keeping observations out of zones, as Column expressions."""

from __future__ import annotations

from math import isfinite
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import codes, grids
from geoloom.functions.core import WGS84, Num, c, let, wrap_longitude

#: Metres of the shortest degree of latitude.
DEGREE_M = 110574.0
_LEVELS = {"geohash": (1, 12), "s2": (0, 30)}


class Precision(NamedTuple):
    """A grid (geohash or s2) and its level."""

    grid: str
    level: int

    @classmethod
    def of(cls, grid: str, level: int) -> Precision:
        if grid not in _LEVELS or not _LEVELS[grid][0] <= level <= _LEVELS[grid][1]:
            raise ValueError((grid, level))
        return cls(grid, level)

    @classmethod
    def geohash(cls, length: int) -> Precision:
        return cls.of("geohash", length)

    @classmethod
    def s2(cls, level: int) -> Precision:
        return cls.of("s2", level)

    @classmethod
    def at_least(cls, meters: float) -> Precision:
        """The finest geohash whose cells are at least that tall."""
        if not (isfinite(meters) and meters >= 0):
            raise ValueError(meters)
        for length in range(12, 0, -1):
            if cls("geohash", length).min_cell_height_m >= meters:
                return cls("geohash", length)
        raise ValueError(f"{meters} m is taller than the coarsest cell")

    @property
    def min_cell_height_m(self) -> float | None:
        """Metres that every cell is tall at least; not known for S2."""
        return 180.0 / 2 ** (5 * self.level // 2) * DEGREE_M if self.grid == "geohash" else None


def coarsen(lat: Num, lon: Num, precision: Precision, crs: str = WGS84) -> Column:
    """STRUCT<lat, lon, max_error_m, source>: the middle of a position's cell, its circumradius and the cell's name.

    Longitude 180 is read as -180, a pole's as 0, so that one place has one cell.
    """
    lat = c(lat)
    lon = F.when(F.abs(lat) == 90.0, F.lit(0.0)).otherwise(wrap_longitude(lon))
    level = precision.level
    if precision.grid == "geohash":
        cell = grids.geohash_cell(lat, lon, level)
        named = lambda x: _named(codes.geohash_middle(x, level, crs), "privacy:geohash:", grids.geohash_name(x, level))
    else:
        cell = grids.s2_grid(lat, lon)
        named = lambda x: _named(codes.s2_middle(x, level, crs), "privacy:s2:", F.lower(F.lpad(F.hex(grids.s2_id(x, level)), 16, "0")))
    return F.when(lat.between(-90, 90) & lon.isNotNull(), let(cell, named))


def _named(middle: Column, grid: str, name: Column) -> Column:
    source = F.concat(F.lit(grid), name).alias("source")
    return let(middle, lambda at: F.struct(at["lat"].alias("lat"), at["lon"].alias("lon"), at["max_error_m"].alias("max_error_m"), source))


def coarsen_fix(lat: Num, lon: Num, kind: Column, horizontal_m: Num, precision: Precision, crs: str = WGS84) -> Column:
    """STRUCT<lat, lon, kind, horizontal_m, source> of an observation: the cell's radius and its own error add.

    A bound stays a bound; another kind of error is no longer of a known kind. With no error of its own the cell bounds it.
    """
    return let(coarsen(lat, lon, precision, crs), lambda at: widened(at, kind, horizontal_m))


def widened(at: Column, kind: Column, horizontal_m: Num) -> Column:
    """:func:`coarsen_fix` of an observation whose position is :func:`coarsen`'s ``at``."""
    known = kind.isNotNull() & c(horizontal_m).isNotNull()
    return F.when(
        at.isNotNull(),
        F.struct(
            at["lat"].alias("lat"), at["lon"].alias("lon"), F.when(known & (kind != "Bound"), "Unspecified").otherwise("Bound").alias("kind"),
            (at["max_error_m"] + F.when(known, c(horizontal_m)).otherwise(0.0)).alias("horizontal_m"), at["source"].alias("source"),
        ),
    )
