"""Web Mercator, tiles, quadkeys, cameras and viewports as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import Num, c, finite_struct, wrap_longitude

#: Radius of the projection, the latitude at the edge of its square, and the deepest tile zoom.
RADIUS, MAX_LAT, MAX_ZOOM = 6378137.0, 85.05112877980659, 30


def unit_x(lon: Num) -> Column:
    return (c(lon) + 180.0) / 360.0


def unit_y(lat: Num) -> Column:
    """Row in the unit square, from the north, of a latitude cut at the projection's edge."""
    s = F.sin(F.radians(F.greatest(F.least(c(lat), F.lit(MAX_LAT)), F.lit(-MAX_LAT))))
    y = F.lit(0.5) - F.log((s + 1.0) / (F.lit(1.0) - s)) / (4.0 * pi)
    return F.greatest(F.least(y, F.lit(1.0)), F.lit(0.0))


def lat_at(y: Num) -> Column:
    return F.degrees(F.atan(F.sinh((F.lit(1.0) - c(y) * 2.0) * pi)))


def web_mercator(lat: Num, lon: Num) -> Column:
    """Metres (x_m, y_m); the latitude is cut at the projection's edge."""
    phi = F.radians(F.greatest(F.least(c(lat), F.lit(MAX_LAT)), F.lit(-MAX_LAT)))
    s = F.sin(phi)
    return F.struct((F.radians(c(lon)) * RADIUS).alias("x_m"), (F.log((s + 1.0) / (F.lit(1.0) - s)) * (RADIUS / 2.0)).alias("y_m"))


def web_mercator_inverse(x_m: Num, y_m: Num) -> Column:
    return F.struct(F.degrees(F.atan(F.sinh(c(y_m) / RADIUS))).alias("lat"), wrap_longitude(F.degrees(c(x_m) / RADIUS)).alias("lon"))


def world_pixel(lat: Num, lon: Num, zoom: Num, tile_px: float) -> Column:
    size = F.pow(F.lit(2.0), c(zoom)) * tile_px
    return F.struct((unit_x(lon) * size).alias("x"), (unit_y(lat) * size).alias("y"))


def world_pixel_inverse(x: Num, y: Num, zoom: Num, tile_px: float) -> Column:
    """The point at a world pixel; x wraps."""
    size = F.pow(F.lit(2.0), c(zoom)) * tile_px
    return F.struct(lat_at(c(y) / size).alias("lat"), wrap_longitude(c(x) / size * 360.0 - 180.0).alias("lon"))


def tile(lat: Num, lon: Num, z: int) -> Column:
    """Tile (z, x, y) of a point; z up to 30, coordinates as BIGINT."""
    if not 0 <= z <= MAX_ZOOM:
        raise ValueError(z)
    n = 1 << z
    part = lambda u: F.greatest(F.least(F.floor(u * float(n)), F.lit(n - 1)), F.lit(0)).cast("bigint")
    return F.struct(F.lit(z).alias("z"), part(unit_x(lon)).alias("x"), part(unit_y(lat)).alias("y"))


def quadkey(t: Column) -> Column:
    """One digit a zoom level, from the top; the empty string at zoom 0."""
    bits = F.sequence(t["z"] - 1, F.lit(0), F.lit(-1))
    digit = lambda k: (F.shiftright(t["x"], 0).bitwiseAND(F.pow(F.lit(2.0), k).cast("bigint")) > 0).cast("int") + (
        t["y"].bitwiseAND(F.pow(F.lit(2.0), k).cast("bigint")) > 0
    ).cast("int") * 2
    return F.when(t["z"] == 0, F.lit("")).otherwise(F.array_join(F.transform(bits, lambda k: digit(k).cast("string")), ""))


def tile_from_quadkey(key: Column) -> Column:
    """Tile of a quadkey of up to 30 digits; null for another string."""
    digits = F.transform(F.filter(F.split(key, ""), lambda d: d != ""), lambda d: d.cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))
    end = F.aggregate(digits, start, lambda a, d: F.struct((a["x"] * 2 + d % 2).alias("x"), (a["y"] * 2 + F.floor(d / 2)).alias("y")))
    return F.when(key.rlike("^[0-3]{0,30}$"), F.struct(F.length(key).alias("z"), end["x"].alias("x"), end["y"].alias("y")))


def tile_bounds(t: Column) -> Column:
    n = F.pow(F.lit(2.0), t["z"])
    return F.struct(
        lat_at((t["y"] + 1) / n).alias("south"), (t["x"] / n * 360.0 - 180.0).alias("west"), lat_at(t["y"] / n).alias("north"), ((t["x"] + 1) / n * 360.0 - 180.0).alias("east")
    )


def tiles_covering(south: Num, west: Num, north: Num, east: Num, z: int, max_tiles: int = 10_000) -> Column:
    """Array of the tiles that cover a box: columns from the west edge, across the antimeridian where west > east, and
    rows from the north in each. Null where there would be more than ``max_tiles``."""
    n = 1 << z
    top, low = tile(north, west, z), tile(south, east, z)
    span = F.when(c(west) > c(east), low["x"] - top["x"] + n).otherwise(low["x"] - top["x"])
    span = F.least(span, F.lit(n - 1))
    count = (span + 1) * (low["y"] - top["y"] + 1)
    columns = F.transform(F.sequence(F.lit(0).cast("bigint"), span), lambda k: F.pmod(top["x"] + k, F.lit(n)))
    rows = F.sequence(top["y"], low["y"])
    tiles = F.flatten(F.transform(columns, lambda x: F.transform(rows, lambda y: F.struct(F.lit(z).alias("z"), x.alias("x"), y.alias("y")))))
    return F.when(count <= max_tiles, tiles)


def _box_span(west: Column, east: Column) -> Column:
    return F.when(west > east, east - west + 360.0).otherwise(east - west)


def fit_bounds(south: Num, west: Num, north: Num, east: Num, width_px: float, height_px: float, tile_px: float = 512.0, padding_px: float = 0.0, max_zoom: float = 22.0) -> Column:
    """Camera (lat, lon, zoom) that shows a whole box inside the padding, no closer than ``max_zoom``."""
    west, east = c(west), c(east)
    wide, high = width_px - 2 * padding_px, height_px - 2 * padding_px
    if wide <= 0 or high <= 0:
        raise ValueError("padding leaves no room")
    dx, y0, y1 = _box_span(west, east) / 360.0, unit_y(north), unit_y(south)
    zoom = lambda room, part: F.when(part > 0, F.log2(F.lit(room / tile_px) / part)).otherwise(F.lit(max_zoom))
    best = F.greatest(F.least(zoom(wide, dx), zoom(high, y1 - y0), F.lit(max_zoom)), F.lit(0.0))
    return F.struct(lat_at((y0 + y1) / 2.0).alias("lat"), wrap_longitude(west + _box_span(west, east) / 2.0).alias("lon"), best.alias("zoom"))


def viewport_bounds(lat: Num, lon: Num, zoom: Num, width_px: float, height_px: float, tile_px: float = 512.0) -> Column:
    """The box that a camera shows; the whole circle of longitudes where the view is as wide as the world."""
    size = F.pow(F.lit(2.0), c(zoom)) * tile_px
    half_x, half_y = F.lit(width_px / 2.0) / size, F.lit(height_px / 2.0) / size
    x, y = unit_x(lon), unit_y(lat)
    whole = half_x * 2.0 >= 1.0
    edge = lambda u: wrap_longitude(u * 360.0 - 180.0)
    return F.struct(
        lat_at(F.least(y + half_y, F.lit(1.0))).alias("south"), F.when(whole, F.lit(-180.0)).otherwise(edge(x - half_x)).alias("west"),
        lat_at(F.greatest(y - half_y, F.lit(0.0))).alias("north"), F.when(whole, F.lit(180.0)).otherwise(edge(x + half_x)).alias("east"),
    )


def abbreviated(count: Column) -> Column:
    """A count as a map label: 999, 1k, 1.2k, 12k."""
    tenth = F.round(count / 100.0).cast("bigint")
    below = F.when(tenth % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("."), (tenth % 10).cast("string")))
    return (
        F.when(count < 1000, count.cast("string"))
        .when(count < 10_000, F.concat(F.floor(tenth / 10).cast("string"), below, F.lit("k")))
        .otherwise(F.concat(F.round(count / 1000.0).cast("bigint").cast("string"), F.lit("k")))
    )


def mercator_point(x_m: Num, y_m: Num) -> Column:
    """Projected metres; null where one is not finite or lies off the projection's square."""
    edge = pi * RADIUS * (1 + 1e-12)
    return finite_struct((F.abs(c(x_m)) <= edge) & (F.abs(c(y_m)) <= edge), x_m=c(x_m), y_m=c(y_m))


def tile_at(z: Column | int, x: Num, y: Num) -> Column:
    """A tile; null for a zoom over 30 or coordinates off its grid."""
    z = z if isinstance(z, Column) else F.lit(z)
    n = F.pow(F.lit(2.0), z)
    ok = z.between(0, MAX_ZOOM) & (c(x) >= 0) & (c(x) < n) & (c(y) >= 0) & (c(y) < n)
    return F.when(ok, F.struct(z.alias("z"), c(x).cast("bigint").alias("x"), c(y).cast("bigint").alias("y")))


def viewport(width_px: Num, height_px: Num, tile_px: Num = 512.0) -> Column:
    """A view's size; null unless all three are finite and positive."""
    return finite_struct((c(width_px) > 0) & (c(height_px) > 0) & (c(tile_px) > 0), width_px=c(width_px), height_px=c(height_px), tile_px=c(tile_px))


def camera(lat: Num, lon: Num, zoom: Num) -> Column:
    """A centre and a zoom of 0 to 30; else null."""
    ok = c(lat).between(-90, 90) & c(lon).between(-180, 180) & c(zoom).between(0, MAX_ZOOM)
    return finite_struct(ok, lat=c(lat), lon=c(lon), zoom=c(zoom))
