"""Spherical measurement, frames, datum shifts and boxes as Column expressions."""

from __future__ import annotations

from math import isfinite, pi
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import NAD27, PULKOVO, TOKYO, WGS84, Num, c, finite, finite_struct, let, normalize_degrees, wrap_longitude

#: Mean radius of the sphere in metres.
SPHERE_M = 6371008.8


class Ellipsoid(NamedTuple):
    a: float
    inverse_f: float

    @property
    def f(self) -> float:
        return 1.0 / self.inverse_f

    @property
    def b(self) -> float:
        return self.a * (1.0 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2.0 - self.f)


# The ellipsoid of each datum that has one, and the shift in metres to WGS-84.
ELLIPSOIDS = {
    WGS84: Ellipsoid(6378137.0, 298.257223563),
    NAD27: Ellipsoid(6378206.4, 294.9786982),
    TOKYO: Ellipsoid(6377397.155, 299.1528128),
    PULKOVO: Ellipsoid(6378245.0, 298.3),
}
SHIFTS = {NAD27: (-8.0, 160.0, 176.0), TOKYO: (-148.0, 507.0, 685.0), PULKOVO: (28.0, -130.0, -95.0)}


def haversine(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Metres on the mean sphere, in the form that is exact for near and for opposite points."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dp, dl = F.sin((p2 - p1) / 2.0), F.sin(F.radians(c(lon2) - c(lon1)) / 2.0)
    h = dp * dp + F.cos(p1) * F.cos(p2) * dl * dl
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h)) * (2.0 * SPHERE_M)


def near_distance(lat1: Num, lon1: Num, lat2: Num, lon2: Num, crs: str = WGS84) -> Column:
    """Metres on the ellipsoid by Lambert's formula, which errs by less than a hundred-thousandth over a grid cell."""
    e = ELLIPSOIDS[crs]
    beta = lambda lat: F.atan(F.tan(F.radians(c(lat))) * (1.0 - e.f))

    def arc(b: Column) -> Column:
        dp, dl = F.sin((b["q"] - b["p"]) / 2.0), F.sin(b["l"] / 2.0)
        h = F.least(F.greatest(dp * dp + F.cos(b["p"]) * F.cos(b["q"]) * dl * dl, F.lit(0.0)), F.lit(1.0))
        return let(F.struct(((b["p"] + b["q"]) / 2.0).alias("mean"), ((b["q"] - b["p"]) / 2.0).alias("half"), (F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h)) * 2.0).alias("s")), flat)

    def flat(v: Column) -> Column:
        turns = [f(x).alias(k) for k, f, x in (("sp", F.sin, v["mean"]), ("cp", F.cos, v["mean"]), ("sq", F.sin, v["half"]), ("cq", F.cos, v["half"]), ("near", F.sin, v["s"] / 2.0), ("far", F.cos, v["s"] / 2.0), ("up", F.sin, v["s"]))]
        return F.when(v["s"] == 0, 0.0).otherwise(let(F.struct(v["s"].alias("s"), *turns), lambert))

    def lambert(w: Column) -> Column:
        x = (w["s"] - w["up"]) * (w["sp"] * w["sp"]) * (w["cq"] * w["cq"]) / (w["far"] * w["far"])
        y = (w["s"] + w["up"]) * (w["cp"] * w["cp"]) * (w["sq"] * w["sq"]) / (w["near"] * w["near"])
        return (w["s"] - (x + y) * (e.f / 2.0)) * e.a

    return let(F.struct(beta(lat1).alias("p"), beta(lat2).alias("q"), F.radians(c(lon2) - c(lon1)).alias("l")), arc)


def initial_bearing_spherical(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    p1, p2, dl = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    return normalize_degrees(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def unit_vector(lat: Num, lon: Num) -> tuple[Column, Column, Column]:
    p, l = F.radians(c(lat)), F.radians(c(lon))
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a) -> Column:
    return F.sqrt(_dot(a, a))


def cross_track_spherical(lat: Num, lon: Num, lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Signed metres from the great circle through the path, positive to its right; null for a path of one point."""
    p, a, b = unit_vector(lat, lon), unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    pole = _cross(a, b)
    size = _norm(pole)
    return F.when(size > 1e-12, -F.asin(F.greatest(F.least(_dot(pole, p) / size, F.lit(1.0)), F.lit(-1.0))) * SPHERE_M + 0.0)


def along_track_spherical(lat: Num, lon: Num, lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Signed metres along the path to the foot of the point; null for a path of one point or a point at the path's pole."""
    p, a, b = unit_vector(lat, lon), unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    pole = _cross(a, b)
    size = _norm(pole)
    ahead = _cross(pole, a)
    x, y = _dot(p, a), _dot(p, ahead) / size
    return F.when((size > 1e-12) & (F.hypot(x, y) > 1e-12), F.atan2(y, x) * SPHERE_M + 0.0)


def intersection_spherical(lat1: Num, lon1: Num, bearing1: Num, lat2: Num, lon2: Num, bearing2: Num) -> Column:
    """Where two great circles meet ahead of both starts: STRUCT<kind, lat, lon> with kind Crossing, SameGreatCircle or
    NoForwardCrossing; of two crossings the one nearer the first start."""

    def heading(lat: Num, lon: Num, bearing: Num):
        p, l, t = F.radians(c(lat)), F.radians(c(lon)), F.radians(c(bearing))
        north = (-F.sin(p) * F.cos(l), -F.sin(p) * F.sin(l), F.cos(p))
        east = (-F.sin(l), F.cos(l), F.lit(0.0))
        return tuple(n * F.cos(t) + e * F.sin(t) for n, e in zip(north, east))

    a, b = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    ta, tb = heading(lat1, lon1, bearing1), heading(lat2, lon2, bearing2)
    na, nb = _cross(a, ta), _cross(b, tb)
    line = _cross(na, nb)
    size = _norm(line)
    side = F.when(_dot(line, ta) >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    x = tuple(v * side for v in line)
    ahead = (_dot(x, ta) >= 0) & (_dot(x, tb) >= 0)
    none = F.lit(None).cast("double")
    found = lambda kind, lat, lon: F.struct(F.lit(kind).alias("kind"), lat.alias("lat"), lon.alias("lon"))
    return (
        F.when(size <= 1e-12, found("SameGreatCircle", none, none))
        .when(ahead, found("Crossing", F.degrees(F.atan2(x[2], F.hypot(x[0], x[1]))), wrap_longitude(F.degrees(F.atan2(x[1], x[0])))))
        .otherwise(found("NoForwardCrossing", none, none))
    )


def to_ecef(lat: Num, lon: Num, height_m: Num = 0.0, crs: str = WGS84) -> Column:
    """Earth-centred metres (x_m, y_m, z_m) of a point with an ellipsoidal height."""
    e = ELLIPSOIDS[crs]
    p, l = F.radians(c(lat)), F.radians(c(lon))
    n = F.lit(e.a) / F.sqrt(F.lit(1.0) - F.sin(p) * F.sin(p) * e.e2)
    h = c(height_m)
    return F.struct(
        ((n + h) * F.cos(p) * F.cos(l)).alias("x_m"), ((n + h) * F.cos(p) * F.sin(l)).alias("y_m"), ((n * (1.0 - e.e2) + h) * F.sin(p)).alias("z_m")
    )


def from_ecef(x: Num, y: Num, z: Num, crs: str = WGS84) -> Column:
    """(lat, lon, height_m) by Bowring's parametric latitude, taken three times; null at the centre.

    Near the earth's surface three turns reach the last bit of a double.
    """
    e = ELLIPSOIDS[crs]
    second = e.e2 / (1.0 - e.e2)

    def solve(v: Column) -> Column:
        x, y, z, r = v["x"], v["y"], v["z"], v["r"]

        def turn(tan_u: Column, _: Column) -> Column:
            cos_u = F.lit(1.0) / F.sqrt(tan_u * tan_u + 1.0)
            return let(
                F.struct(cos_u.alias("c"), (tan_u * cos_u).alias("s")),
                lambda u: (z + u["s"] * u["s"] * u["s"] * (second * e.b)) / (r - u["c"] * u["c"] * u["c"] * (e.e2 * e.a)) * (1.0 - e.f),
            )

        tan_u = F.aggregate(F.sequence(F.lit(1), F.lit(3)), z / r * (e.a / e.b), turn)
        p = F.when(r == 0, F.signum(z) * (pi / 2)).otherwise(F.atan(tan_u / (1.0 - e.f)))

        def finish(p: Column) -> Column:
            w2 = F.lit(1.0) - F.sin(p) * F.sin(p) * e.e2
            high = F.when(r == 0, F.abs(z) - e.b).otherwise(r * F.cos(p) + z * F.sin(p) - F.sqrt(w2) * e.a)
            lon = F.when(r == 0, F.lit(0.0)).otherwise(wrap_longitude(F.degrees(F.atan2(y, x))))
            return F.struct(F.degrees(p).alias("lat"), lon.alias("lon"), high.alias("height_m"))

        return F.when((r > 0) | (z != 0), let(p, finish))

    point = F.struct(c(x).alias("x"), c(y).alias("y"), c(z).alias("z"), F.hypot(c(x), c(y)).alias("r"))
    return let(point, solve)


def to_enu(lat: Num, lon: Num, height_m: Num, lat0: Num, lon0: Num, height0_m: Num, crs: str = WGS84) -> Column:
    """Metres (east_m, north_m, up_m) of a point seen from an origin."""
    t, o = to_ecef(lat, lon, height_m, crs), to_ecef(lat0, lon0, height0_m, crs)
    dx, dy, dz = (t[k] - o[k] for k in ("x_m", "y_m", "z_m"))
    p, l = F.radians(c(lat0)), F.radians(c(lon0))
    flat = dx * F.cos(l) + dy * F.sin(l)
    return F.struct(
        (dy * F.cos(l) - dx * F.sin(l)).alias("east_m"), (dz * F.cos(p) - flat * F.sin(p)).alias("north_m"), (flat * F.cos(p) + dz * F.sin(p)).alias("up_m")
    )


def from_enu(enu: Column, lat0: Num, lon0: Num, height0_m: Num, crs: str = WGS84) -> Column:
    o = to_ecef(lat0, lon0, height0_m, crs)
    p, l = F.radians(c(lat0)), F.radians(c(lon0))
    e, n, u = enu["east_m"], enu["north_m"], enu["up_m"]
    flat = u * F.cos(p) - n * F.sin(p)
    return from_ecef(o["x_m"] + flat * F.cos(l) - e * F.sin(l), o["y_m"] + flat * F.sin(l) + e * F.cos(l), o["z_m"] + u * F.sin(p) + n * F.cos(p), crs)


def enu_to_ned(enu: Column) -> Column:
    return F.struct(enu["north_m"].alias("north_m"), enu["east_m"].alias("east_m"), (-enu["up_m"]).alias("down_m"))


def ned_to_enu(ned: Column) -> Column:
    return F.struct(ned["east_m"].alias("east_m"), ned["north_m"].alias("north_m"), (-ned["down_m"]).alias("up_m"))


def enu_to_aer(enu: Column) -> Column:
    """Azimuth in [0, 360), elevation and range."""
    flat = F.hypot(enu["east_m"], enu["north_m"])
    return F.struct(
        normalize_degrees(F.degrees(F.atan2(enu["east_m"], enu["north_m"]))).alias("azimuth_deg"),
        F.degrees(F.atan2(enu["up_m"], flat)).alias("elevation_deg"), F.hypot(flat, enu["up_m"]).alias("range_m"),
    )


def aer_to_enu(aer: Column) -> Column:
    a, e, r = F.radians(aer["azimuth_deg"]), F.radians(aer["elevation_deg"]), aer["range_m"]
    return F.struct((r * F.cos(e) * F.sin(a)).alias("east_m"), (r * F.cos(e) * F.cos(a)).alias("north_m"), (r * F.sin(e)).alias("up_m"))


class Helmert(NamedTuple):
    """Seven parameters in the position-vector convention: metres, arc seconds, parts per million."""

    tx: float
    ty: float
    tz: float
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0

    def inverse_first_order(self) -> Helmert:
        return Helmert(*[-v for v in self])


def helmert(ecef: Column, h: Helmert) -> Column:
    rx, ry, rz = (v * pi / 648000.0 for v in (h.rx, h.ry, h.rz))
    s = 1.0 + h.ppm * 1e-6
    x, y, z = ecef["x_m"], ecef["y_m"], ecef["z_m"]
    return F.struct(
        ((x - y * rz + z * ry) * s + h.tx).alias("x_m"), ((x * rz + y - z * rx) * s + h.ty).alias("y_m"), ((y * rx - x * ry + z) * s + h.tz).alias("z_m")
    )


def shift_datum(lat: Num, lon: Num, from_crs: str, to_crs: str = WGS84) -> Column:
    """(lat, lon) moved between a catalogued datum and WGS-84, either way."""
    if WGS84 not in (from_crs, to_crs):
        raise ValueError("one side must be WGS84")
    h = Helmert(*SHIFTS[from_crs]) if to_crs == WGS84 else Helmert(*SHIFTS[to_crs]).inverse_first_order()
    e = helmert(to_ecef(lat, lon, 0.0, from_crs), h)
    g = from_ecef(e["x_m"], e["y_m"], e["z_m"], to_crs)
    return F.struct(g["lat"].alias("lat"), g["lon"].alias("lon"))


def box(south: Num, west: Num, north: Num, east: Num) -> Column:
    """A box; west > east crosses the antimeridian. Null for edges out of range or south over north."""
    south, west, north, east = c(south), c(west), c(north), c(east)
    ok = south.between(-90, 90) & north.between(-90, 90) & west.between(-180, 180) & east.between(-180, 180) & (south <= north)
    return F.when(ok, F.struct(south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east")))


def _in_arc(west: Column, east: Column, lon: Column) -> Column:
    one = lambda x: F.when(west <= east, x.between(west, east)).otherwise((x >= west) | (x <= east))
    return one(lon) | ((F.abs(lon) == 180.0) & one(-lon))


def box_contains(b: Column, lat: Num, lon: Num) -> Column:
    """Edges belong to the box, a pole has every longitude, and 180 is -180."""
    lat, lon = c(lat), c(lon)
    return lat.between(b["south"], b["north"]) & ((F.abs(lat) == 90.0) | _in_arc(b["west"], b["east"], lon))


def box_intersects(a: Column, b: Column) -> Column:
    apart = (a["south"] > b["north"]) | (b["south"] > a["north"])
    pole = ((a["north"] == 90.0) & (b["north"] == 90.0)) | ((a["south"] == -90.0) & (b["south"] == -90.0))
    return ~apart & (pole | _in_arc(a["west"], a["east"], b["west"]) | _in_arc(b["west"], b["east"], a["west"]))


def box_span(b: Column) -> Column:
    return F.when(b["west"] > b["east"], b["east"] - b["west"] + 360.0).otherwise(b["east"] - b["west"])


def box_center(b: Column) -> Column:
    return F.struct((b["south"] + (b["north"] - b["south"]) / 2.0).alias("lat"), wrap_longitude(b["west"] + box_span(b) / 2.0).alias("lon"))


def ecef(x_m: Num, y_m: Num, z_m: Num) -> Column:
    """Earth-centred metres; null where one is not finite."""
    return finite_struct(x_m=c(x_m), y_m=c(y_m), z_m=c(z_m))


def enu(east_m: Num, north_m: Num, up_m: Num) -> Column:
    return finite_struct(east_m=c(east_m), north_m=c(north_m), up_m=c(up_m))


def ned(north_m: Num, east_m: Num, down_m: Num) -> Column:
    return finite_struct(north_m=c(north_m), east_m=c(east_m), down_m=c(down_m))


def aer(azimuth_deg: Num, elevation_deg: Num, range_m: Num) -> Column:
    """Azimuth brought to [0, 360); null for an elevation past the zenith, a negative range or a value that is not finite."""
    ok = c(elevation_deg).between(-90, 90) & (c(range_m) >= 0) & finite(azimuth_deg)
    return finite_struct(ok, azimuth_deg=normalize_degrees(azimuth_deg), elevation_deg=c(elevation_deg), range_m=c(range_m))


def to_ned(lat: Num, lon: Num, height_m: Num, lat0: Num, lon0: Num, height0_m: Num, crs: str = WGS84) -> Column:
    return let(to_enu(lat, lon, height_m, lat0, lon0, height0_m, crs), enu_to_ned)


def from_ned(ned: Column, lat0: Num, lon0: Num, height0_m: Num, crs: str = WGS84) -> Column:
    return from_enu(ned_to_enu(ned), lat0, lon0, height0_m, crs)


def ned_to_aer(ned: Column) -> Column:
    return enu_to_aer(ned_to_enu(ned))


def aer_to_ned(aer: Column) -> Column:
    return let(aer_to_enu(aer), enu_to_ned)


def to_aer(lat: Num, lon: Num, height_m: Num, lat0: Num, lon0: Num, height0_m: Num, crs: str = WGS84) -> Column:
    return let(to_enu(lat, lon, height_m, lat0, lon0, height0_m, crs), enu_to_aer)


def from_aer(aer: Column, lat0: Num, lon0: Num, height0_m: Num, crs: str = WGS84) -> Column:
    return let(aer_to_enu(aer), lambda e: from_enu(e, lat0, lon0, height0_m, crs))


class DatumTransform(NamedTuple):
    """A seven-parameter shift between two datums that have ellipsoids, with the accuracy that is claimed for it."""

    from_crs: str
    to_crs: str
    shift: Helmert
    accuracy_m: float | None = None

    @classmethod
    def checked(cls, from_crs: str, to_crs: str, shift: Helmert, accuracy_m: float | None = None) -> DatumTransform:
        if from_crs == to_crs or not {from_crs, to_crs} <= set(ELLIPSOIDS):
            raise ValueError((from_crs, to_crs))
        if not all(isfinite(v) for v in shift) or (accuracy_m is not None and not (isfinite(accuracy_m) and accuracy_m >= 0)):
            raise ValueError("parameters must be finite and the accuracy not negative")
        return cls(from_crs, to_crs, shift, accuracy_m)

    @classmethod
    def to_wgs84(cls, datum: str) -> DatumTransform | None:
        """The catalogued shift of a datum; none for others."""
        return cls(datum, WGS84, Helmert(*SHIFTS[datum])) if datum in SHIFTS else None

    def reverse(self) -> DatumTransform:
        return DatumTransform(self.to_crs, self.from_crs, self.shift.inverse_first_order(), self.accuracy_m)

    def apply(self, lat: Num, lon: Num, height_m: Num | None = None) -> Column:
        """(lat, lon, height_m) in the other datum; without a height the result has none either."""
        flat = F.lit(None).cast("double") if height_m is None else c(height_m)
        moved = helmert(to_ecef(lat, lon, F.coalesce(flat, F.lit(0.0)), self.from_crs), self.shift)
        there = let(moved, lambda e: from_ecef(e["x_m"], e["y_m"], e["z_m"], self.to_crs))
        return let(there, lambda g: F.struct(g["lat"].alias("lat"), g["lon"].alias("lon"), F.when(flat.isNotNull(), g["height_m"]).alias("height_m")))


def box_crosses_antimeridian(b: Column) -> Column:
    return b["west"] > b["east"]


def box_union(a: Column, b: Column) -> Column:
    """The smallest box over two boxes, the shorter way round; of ways equally long the one from the first box's west.

    A box that is one pole has no longitudes of its own.
    """
    pole = lambda x: (x["south"] == x["north"]) & (F.abs(x["south"]) == 90.0)
    # Going east from a west edge, how far the other box reaches.
    reach = lambda x, y: F.greatest(box_span(x), F.pmod(y["west"] - x["west"], F.lit(360.0)) + box_span(y))
    arc = lambda w, e: F.struct(w.alias("west"), e.alias("east"))

    def joined(way: Column) -> Column:
        first = way["a"] <= way["b"]
        start, span = F.when(first, a["west"]).otherwise(b["west"]), F.least(way["a"], way["b"])
        own = F.when(first, F.when(span == box_span(a), a["east"]).otherwise(b["east"])).otherwise(F.when(span == box_span(b), b["east"]).otherwise(a["east"]))
        return F.when(span >= 360.0, arc(F.lit(-180.0), F.lit(180.0))).otherwise(arc(start, own))

    arcs = (
        F.when(pole(a) & pole(b), arc(F.lit(0.0), F.lit(0.0)))
        .when(pole(a), arc(b["west"], b["east"]))
        .when(pole(b), arc(a["west"], a["east"]))
        .otherwise(let(F.struct(reach(a, b).alias("a"), reach(b, a).alias("b")), joined))
    )
    return let(arcs, lambda r: F.struct(F.least(a["south"], b["south"]).alias("south"), r["west"].alias("west"), F.greatest(a["north"], b["north"]).alias("north"), r["east"].alias("east")))
