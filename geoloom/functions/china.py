"""The China datums GCJ-02 and BD-09 and Baidu's projection, as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import BD09, CRS, GCJ02, WGS84, Num, c, coordinate, finite_struct, let, wrap_longitude
from geoloom.functions.geodesy import SHIFTS, shift_datum

# The closed box inside which GCJ-02 differs from WGS-84, and the offset's spheroid.
BOX = {"west": 72.004, "east": 137.8347, "south": 0.8293, "north": 55.8271}
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162296594
X_PI = pi * 3000.0 / 180.0
#: Bounds in metres of the one-step inverses, and the metres per radian that residuals are measured with.
FAST_GCJ_M, FAST_BD_M, FAST_BD_EDGE_M, METERS_PER_RADIAN = 6.0, 0.5, 125.0, 6.4e6


def in_china_box(lat: Num, lon: Num, margin: float = 0.0) -> Column:
    return c(lon).between(BOX["west"] - margin, BOX["east"] + margin) & c(lat).between(BOX["south"] - margin, BOX["north"] + margin)


def is_outside_china(lat: Num, lon: Num) -> Column:
    return ~in_china_box(lat, lon)


def _waves(terms: list[tuple[float, Column]]) -> Column:
    """Two thirds of the sum of amplitude times sine of an angle."""
    total = None
    for size, angle in terms:
        wave = F.lit(size) * F.sin(angle)
        total = wave if total is None else total + wave
    return total * 2.0 / 3.0


def _offset(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Degrees that GCJ-02 adds to latitude and longitude, with no box."""
    x, y = lon - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))
    shared = _waves([(20.0, x * 6.0 * pi), (20.0, x * 2.0 * pi)])
    north = (
        F.lit(-100.0) + x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + root * 0.2
        + shared
        + _waves([(20.0, y * pi), (40.0, y * (pi / 3.0))])
        + _waves([(160.0, y * (pi / 12.0)), (320.0, y * (pi / 30.0))])
    )
    east = (
        F.lit(300.0) + x + y * 2.0 + x * x * 0.1 + x * y * 0.1 + root * 0.1
        + shared
        + _waves([(20.0, x * pi), (40.0, x * (pi / 3.0))])
        + _waves([(150.0, x * (pi / 12.0)), (300.0, x * (pi / 30.0))])
    )
    phi = F.radians(lat)
    w2 = F.lit(1.0) - F.sin(phi) * F.sin(phi) * GCJ_EE
    w = F.sqrt(w2)
    return north * 180.0 / (F.lit(GCJ_A * (1.0 - GCJ_EE)) / (w2 * w) * pi), east * 180.0 / (F.lit(GCJ_A) / w * F.cos(phi) * pi)


def _pair(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def _until_rest(start: Column, step, steps: int, run: int = 8) -> Column:
    """A fold of ``steps`` steps that stand still once ``rest`` is small; runs of steps after that are passed over."""
    many = lambda at, n: F.when(at["rest"] < 1e-9, at).otherwise(F.aggregate(F.sequence(F.lit(1), n), at, step))
    return F.aggregate(F.array(*[F.lit(min(run, steps - k)) for k in range(0, steps, run)]), start, many)


def _offset_once(lat: Column, lon: Column) -> Column:
    """:func:`_offset` as a pair for use inside of folds, where nothing finds what formulas share."""
    x, y, phi = lon - 105.0, lat - 35.0, F.radians(lat)

    def degrees(v: Column) -> Column:
        x, y, root, shared = v["x"], v["y"], v["root"], v["shared"]
        north = (
            F.lit(-100.0) + x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + root * 0.2
            + shared
            + _waves([(20.0, y * pi), (40.0, y * (pi / 3.0))])
            + _waves([(160.0, y * (pi / 12.0)), (320.0, y * (pi / 30.0))])
        )
        east = (
            F.lit(300.0) + x + y * 2.0 + x * x * 0.1 + x * y * 0.1 + root * 0.1
            + shared
            + _waves([(20.0, x * pi), (40.0, x * (pi / 3.0))])
            + _waves([(150.0, x * (pi / 12.0)), (300.0, x * (pi / 30.0))])
        )
        w2 = F.lit(1.0) - v["s"] * v["s"] * GCJ_EE
        scaled = lambda q: _pair(north * 180.0 / (F.lit(GCJ_A * (1.0 - GCJ_EE)) / (q["w2"] * q["w"]) * pi), east * 180.0 / (F.lit(GCJ_A) / q["w"] * F.cos(v["phi"]) * pi))
        return let(let(w2, lambda q: F.struct(q.alias("w2"), F.sqrt(q).alias("w"))), scaled)

    shared = lambda x: _waves([(20.0, x * 6.0 * pi), (20.0, x * 2.0 * pi)])
    return let(F.struct(x.alias("x"), y.alias("y"), F.sqrt(F.abs(x)).alias("root"), shared(x).alias("shared"), phi.alias("phi"), F.sin(phi).alias("s")), degrees)


def wgs84_to_gcj02(lat: Num, lon: Num) -> Column:
    """(lat, lon) in GCJ-02; unchanged outside the box."""
    lat, lon = c(lat), c(lon)
    dlat, dlon = _offset(lat, lon)
    return F.when(in_china_box(lat, lon), _pair(lat + dlat, lon + dlon)).otherwise(_pair(lat, lon))


def gap_m(lat: Column, dlat: Column, dlon: Column) -> Column:
    """Metres of a small difference in degrees, never understated."""
    return F.hypot(F.radians(dlat), F.radians(dlon)) * METERS_PER_RADIAN


def gcj02_to_wgs84_fast(lat: Num, lon: Num) -> Column:
    """One-step inverse (lat, lon, max_error_m): the offset at the GCJ-02 point is taken away.

    The bound is 6 m, and more by the residual where the step crossed the edge of the box.
    """
    lat, lon = c(lat), c(lon)
    dlat, dlon = _offset(lat, lon)

    def bounded(at: Column) -> Column:
        def finish(again: Column) -> Column:
            rest = gap_m(lat, again["lat"] - lat, again["lon"] - lon)
            bound = F.when(rest <= FAST_GCJ_M, F.lit(FAST_GCJ_M)).otherwise(rest + FAST_GCJ_M)
            return F.struct(at["lat"].alias("lat"), at["lon"].alias("lon"), bound.alias("max_error_m"))

        return let(wgs84_to_gcj02(at["lat"], at["lon"]), finish)

    inside = let(_pair(lat - dlat, lon - dlon), bounded)
    return F.when(in_china_box(lat, lon), inside).otherwise(F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(0.0).alias("max_error_m")))


def gcj02_to_wgs84_refined(lat: Num, lon: Num, steps: int = 100) -> Column:
    """Fixed point of the forward map to 1e-9 degrees (lat, lon, max_error_m), as a fold that stops changing once it has
    converged; the bound is 0.5 m, and more by the residual if ``steps`` did not suffice."""
    lat, lon = c(lat), c(lon)
    start = F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(float("inf")).alias("rest"))

    def step(at: Column, _: Column) -> Column:
        missed = lambda d: _pair(at["lat"] + d["lat"] - lat, at["lon"] + d["lon"] - lon)
        moved = lambda m: F.struct(
            (at["lat"] - m["lat"]).alias("lat"), (at["lon"] - m["lon"]).alias("lon"), F.greatest(F.abs(m["lat"]), F.abs(m["lon"])).alias("rest")
        )
        return F.when(at["rest"] < 1e-9, at).otherwise(let(let(_offset_once(at["lat"], at["lon"]), missed), moved))

    def finish(end: Column) -> Column:
        bound = F.when(end["rest"] < 1e-9, F.lit(0.5)).otherwise(F.radians(end["rest"]) * METERS_PER_RADIAN + 0.5)
        return F.struct(end["lat"].alias("lat"), end["lon"].alias("lon"), bound.alias("max_error_m"))

    inside = let(_until_rest(start, step, steps), finish)
    return F.when(in_china_box(lat, lon), inside).otherwise(F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(0.0).alias("max_error_m")))


def gcj02_to_bd09(lat: Num, lon: Num) -> Column:
    """(lat, lon) in BD-09: a nudge of polar radius and angle, everywhere; null past a pole."""
    lat, lon = c(lat), c(lon)
    z = F.sqrt(lon * lon + lat * lat) + F.sin(lat * X_PI) * 0.00002
    theta = F.atan2(lat, lon) + F.cos(lon * X_PI) * 0.000003
    flat = lambda p: _pair(p["z"] * F.sin(p["theta"]) + 0.006, p["z"] * F.cos(p["theta"]) + 0.0065)
    there = lambda p: F.when(p["lat"].between(-90, 90), _pair(p["lat"], wrap_longitude(p["lon"])))
    return let(let(F.struct(z.alias("z"), theta.alias("theta")), flat), there)


def bd09_to_gcj02_fast(lat: Num, lon: Num) -> Column:
    """Closed-form inverse (lat, lon, max_error_m); null past a pole."""
    lat, lon = c(lat), c(lon)
    x, y = lon - 0.0065, lat - 0.006
    z = F.sqrt(x * x + y * y) - F.sin(y * X_PI) * 0.00002
    theta = F.atan2(y, x) - F.cos(x * X_PI) * 0.000003
    bound = F.when(F.abs(lon) >= 180.0 - 0.02, F.lit(FAST_BD_EDGE_M)).otherwise(F.lit(FAST_BD_M))
    flat = lambda p: _pair(p["z"] * F.sin(p["theta"]), p["z"] * F.cos(p["theta"]))
    there = lambda p: F.when(p["lat"].between(-90, 90), F.struct(p["lat"].alias("lat"), wrap_longitude(p["lon"]).alias("lon"), bound.alias("max_error_m")))
    return let(let(F.struct(z.alias("z"), theta.alias("theta")), flat), there)


def wgs84_to_bd09(lat: Num, lon: Num) -> Column:
    return let(wgs84_to_gcj02(lat, lon), lambda g: gcj02_to_bd09(g["lat"], g["lon"]))


def bd09_to_wgs84_fast(lat: Num, lon: Num) -> Column:
    """Both one-step inverses; the bounds add."""

    def both(g: Column) -> Column:
        return let(
            gcj02_to_wgs84_fast(g["lat"], g["lon"]),
            lambda w: F.struct(w["lat"].alias("lat"), w["lon"].alias("lon"), (w["max_error_m"] + g["max_error_m"]).alias("max_error_m")),
        )

    return let(bd09_to_gcj02_fast(lat, lon), lambda g: F.when(g.isNotNull(), both(g)))


def bd09_to_gcj02_refined(lat: Num, lon: Num, steps: int = 100) -> Column:
    """Fixed point of the nudge to 1e-9 degrees (lat, lon, max_error_m), started at the closed form; null past a pole.

    The bound is 0.5 m, and more by the residual if ``steps`` did not suffice.
    """
    lat, lon = c(lat), c(lon)

    def solve(first: Column) -> Column:
        start = F.struct(first["lat"].alias("lat"), first["lon"].alias("lon"), F.lit(float("inf")).alias("rest"))

        def step(at: Column, _: Column) -> Column:
            def moved(again: Column) -> Column:
                back = lambda m: F.struct(
                    (at["lat"] - m["lat"]).alias("lat"), wrap_longitude(at["lon"] - m["lon"]).alias("lon"), F.greatest(F.abs(m["lat"]), F.abs(m["lon"])).alias("rest")
                )
                return let(_pair(again["lat"] - lat, wrap_longitude(again["lon"] - lon)), back)

            next_ = let(gcj02_to_bd09(at["lat"], at["lon"]), moved)
            return F.when(at["rest"] < 1e-9, at).otherwise(F.coalesce(next_, at))

        def finish(end: Column) -> Column:
            bound = F.when(end["rest"] < 1e-9, F.lit(FAST_BD_M)).otherwise(F.radians(F.least(end["rest"], F.lit(180.0))) * METERS_PER_RADIAN + FAST_BD_M)
            return F.struct(end["lat"].alias("lat"), end["lon"].alias("lon"), bound.alias("max_error_m"))

        return F.when(first.isNotNull(), let(_until_rest(start, step, steps), finish))

    return let(bd09_to_gcj02_fast(lat, lon), solve)


def bd09_to_wgs84_refined(lat: Num, lon: Num) -> Column:
    """Both refined inverses; the bounds add."""

    def both(g: Column) -> Column:
        return let(
            gcj02_to_wgs84_refined(g["lat"], g["lon"]),
            lambda w: F.struct(w["lat"].alias("lat"), w["lon"].alias("lon"), (w["max_error_m"] + g["max_error_m"]).alias("max_error_m")),
        )

    return let(bd09_to_gcj02_refined(lat, lon), lambda g: F.when(g.isNotNull(), both(g)))


# Fixed values of Baidu's projection: the lower edges of bands of northing and of latitude, the farthest of each, and for each
# band the longitude's two coefficients, the latitude's polynomial and its scale.
NORTHINGS, LATITUDES = (8362377.87, 5591021.0, 3481989.83, 1678043.12), (60.0, 45.0, 30.0, 15.0)
MAX_NORTHING, MAX_LATITUDE = 12474104.174141884, 74.0
TO_DEGREES = (
    (-7.435856389565537e-9, 0.000008983055097726239, -0.78625201886289, 96.32687599759846, -1.85204757529826, -59.36935905485877, 47.40033549296737, -16.50741931063887, 2.28786674699375, 10260144.86),
    (-3.030883460898826e-8, 0.00000898305509983578, 0.30071316287616, 59.74293618442277, 7.357984074871, -25.38371002664745, 13.45380521110908, -3.29883767235584, 0.32710905363475, 6856817.37),
    (-1.981981304930552e-8, 0.000008983055099779535, 0.03278182852591, 40.31678527705744, 0.65659298677277, -4.44255534477492, 0.85341911805263, 0.12923347998204, -0.04625736007561, 4482777.06),
    (3.09191371068437e-9, 0.000008983055096812155, 0.00006995724062, 23.10934304144901, -0.00023663490511, -0.6321817810242, -0.00663494467273, 0.03430082397953, -0.00466043876332, 2555164.4),
    (2.890871144776878e-9, 0.000008983055095805407, -3.068298e-8, 7.47137025468032, -0.00000353937994, -0.02145144861037, -0.00001234426596, 0.00010322952773, -0.00000323890364, 826088.5),
)
TO_METERS = (
    (0.0008277824516172526, 111320.7020463578, 647795574.6671607, -4082003173.641316, 10774905663.51142, -15171875531.51559, 12053065338.62167, -5124939663.577472, 913311935.9512032, 67.5),
    (0.00337398766765, 111320.7020202162, 4481351.045890365, -23393751.19931662, 79682215.47186455, -115964993.2797253, 97236711.15602145, -43661946.33752821, 8477230.501135234, 52.5),
    (0.00220636496208, 111320.7020209128, 51751.86112841131, 3796837.749470245, 992013.7397791013, -1221952.21711287, 1340652.697009075, -620943.6990984312, 144416.9293806241, 37.5),
    (-0.0003441963504368392, 111320.7020576856, 278.2353980772752, 2485758.690035394, 6070.750963243378, 54821.18345352118, 9540.606633304236, -2710.55326746645, 1405.483844121726, 22.5),
    (-0.0003218135878613132, 111320.7020701615, 0.00369383431289, 823725.6402795718, 0.46104986909093, 2351.343141331292, 1.58060784298199, 8.77738589078284, 0.37238884252424, 7.45),
)


def _banded(edges: tuple[float, ...], table: tuple[tuple[float, ...], ...], across: Column, along: Column) -> Column:
    """STRUCT<across, along>: a line across and a polynomial along, by the band of ``along``; signs are kept."""
    size = F.abs(along)

    def by(row: tuple[float, ...]) -> Column:
        x, total = size / row[9], F.lit(0.0)
        for k in reversed(row[2:9]):
            total = total * x + k
        sign = lambda v: F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.struct(((F.abs(across) * row[1] + row[0]) * sign(across)).alias("across"), (total * sign(along)).alias("along"))

    out = by(table[-1])
    for edge, row in reversed(list(zip(edges, table))):
        out = F.when(size >= edge, by(row)).otherwise(out)
    return out


def baidu_point(x_m: Num, y_m: Num) -> Column:
    """Baidu's projected metres; null where one is not finite."""
    return finite_struct(x_m=c(x_m), y_m=c(y_m))


def bd09_to_baidu(lat: Num, lon: Num) -> Column:
    """Metres (x_m, y_m) of a BD-09 position; null past 74 degrees of latitude."""
    made = let(_banded(LATITUDES, TO_METERS, c(lon), c(lat)), lambda m: F.struct(m["across"].alias("x_m"), m["along"].alias("y_m")))
    return F.when(F.abs(c(lat)) <= MAX_LATITUDE, made)


def baidu_to_bd09(x_m: Num, y_m: Num) -> Column:
    """BD-09 (lat, lon) of Baidu's metres; null past 74 degrees of latitude or 180 of longitude.

    The two directions are fits of their own: there and back drifts by up to 0.25 m under 60 degrees, 7 m beyond.
    """
    made = let(_banded(NORTHINGS, TO_DEGREES, c(x_m), c(y_m)), lambda d: F.when(F.abs(d["across"]) <= 180.0, _pair(d["along"], d["across"])))
    return F.when(F.abs(c(y_m)) <= MAX_NORTHING, made)


def coordinate_to_baidu(point: Column) -> Column:
    """Metres of a BD-09 coordinate; null for another datum."""
    return F.when(point["crs"] == BD09, bd09_to_baidu(point["lat"], point["lon"]))


def baidu_to_coordinate(m: Column) -> Column:
    return let(baidu_to_bd09(m["x_m"], m["y_m"]), lambda p: coordinate(p["lat"], p["lon"], BD09))


def to_crs(point: Column, crs: str) -> Column:
    """STRUCT<lat, lon, crs, max_error_m> of a coordinate in another reference system.

    Its own system gives the point itself; GCJ-02 and BD-09 convert directly; all else goes through WGS-84 and the bounds
    of the legs add. Catalogued shifts are exact as formulas, so they add none. Null past a pole, or for an unknown system.
    """
    if crs not in CRS:
        raise ValueError(crs)
    return let(point, lambda p: _in_crs(p, crs))


def _in_crs(point: Column, crs: str) -> Column:
    lat, lon = point["lat"], point["lon"]
    exact = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), F.lit(0.0).alias("max_error_m"))
    same = F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(0.0).alias("max_error_m"))
    hub = (
        F.when(point["crs"] == WGS84, same).when(point["crs"] == GCJ02, gcj02_to_wgs84_refined(lat, lon)).when(point["crs"] == BD09, bd09_to_wgs84_refined(lat, lon))
    )
    for datum in SHIFTS:
        hub = hub.when(point["crs"] == datum, let(shift_datum(lat, lon, datum), exact))

    def onward(w: Column) -> Column:
        if crs == WGS84:
            return w
        p = {GCJ02: wgs84_to_gcj02, BD09: wgs84_to_bd09}.get(crs, lambda a, b: shift_datum(a, b, WGS84, crs))(w["lat"], w["lon"])
        return let(p, lambda q: F.when(q.isNotNull(), F.struct(q["lat"].alias("lat"), q["lon"].alias("lon"), w["max_error_m"].alias("max_error_m"))))

    out = F.when(point["crs"] == crs, same)
    if crs == BD09:
        out = out.when(point["crs"] == GCJ02, let(gcj02_to_bd09(lat, lon), exact))
    if crs == GCJ02:
        out = out.when(point["crs"] == BD09, bd09_to_gcj02_refined(lat, lon))
    out = out.otherwise(let(hub, onward))
    return let(out, lambda r: F.when(r["lat"].isNotNull(), F.struct(r["lat"].alias("lat"), r["lon"].alias("lon"), F.lit(crs).alias("crs"), r["max_error_m"].alias("max_error_m"))))


def display_coordinate(lat: Num, lon: Num, display: str = GCJ02) -> Column:
    """A WGS-84 position as a map draws it: GCJ-02 or WGS-84 tiles."""
    if display not in (WGS84, GCJ02):
        raise ValueError(display)
    return _pair(c(lat), c(lon)) if display == WGS84 else wgs84_to_gcj02(lat, lon)


def tap_to_wgs84(lat: Num, lon: Num, display: str = GCJ02) -> Column:
    """WGS-84 (lat, lon, max_error_m) of a place tapped on a map."""
    if display == WGS84:
        return F.struct(c(lat).alias("lat"), c(lon).alias("lon"), F.lit(0.0).alias("max_error_m"))
    return gcj02_to_wgs84_refined(lat, lon)
