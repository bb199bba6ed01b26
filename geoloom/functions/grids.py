"""Geohash, Maidenhead, Plus Code and UTM as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import WGS84, Num, c, clamp_latitude, let, wrap_longitude
from geoloom.functions.geodesy import ELLIPSOIDS

# The digits of the codes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
PLUS = "23456789CFGHJMPQRVWX"


def _digit(alphabet: str, k: Column) -> Column:
    return F.substring(F.lit(alphabet), k.cast("int") + 1, F.lit(1))


def _geohash_bits(length: int) -> tuple[int, int]:
    """Bits of longitude and of latitude."""
    if not 1 <= length <= 12:
        raise ValueError(length)
    return (5 * length + 1) // 2, 5 * length // 2


def geohash_cell(lat: Num, lon: Num, length: int) -> Column:
    """STRUCT<x, y>: column and row of the cell of a geohash."""
    part = lambda u, n: F.greatest(F.least(F.floor(u * float(1 << n)).cast("bigint"), F.lit((1 << n) - 1)), F.lit(0))
    n_lon, n_lat = _geohash_bits(length)
    return F.struct(part((c(lon) + 180.0) / 360.0, n_lon).alias("x"), part((c(lat) + 90.0) / 180.0, n_lat).alias("y"))


def geohash_name(cell: Column, length: int) -> Column:
    """A cell's geohash."""
    n_lon, n_lat = _geohash_bits(length)
    out = []
    for k in range(length):
        # A character has three bits of one axis, and two of the other between them.
        (three, a), (two, b) = (("x", n_lon - 3 - 5 * k // 2), ("y", n_lat - 2 - 5 * k // 2)) if k % 2 == 0 else (("y", n_lat - 3 - 5 * k // 2), ("x", n_lon - 3 - 5 * k // 2))
        letters = "".join(GEOHASH[(i & 4) << 2 | (i & 2) << 1 | i & 1 | (j & 2) << 2 | (j & 1) << 1] for i in range(8) for j in range(4))
        out.append(_digit(letters, F.shiftright(cell[three], a).bitwiseAND(7) * 4 + F.shiftright(cell[two], b).bitwiseAND(3)))
    return F.concat(*out)


def geohash_box(cell: Column, length: int) -> Column:
    """STRUCT<south, west, north, east> of a cell."""
    n_lon, n_lat = _geohash_bits(length)
    w, h = 360.0 / 2**n_lon, 180.0 / 2**n_lat
    south, west = cell["y"] * h - 90.0, cell["x"] * w - 180.0
    return F.struct(south.alias("south"), west.alias("west"), (south + h).alias("north"), (west + w).alias("east"))


def geohash(lat: Num, lon: Num, length: int) -> Column:
    """Geohash of 1 to 12 characters; the last row and column take the edges 90 and 180."""
    return let(geohash_cell(lat, lon, length), lambda cell: geohash_name(cell, length))


def geohash_bounds(code: Column) -> Column:
    """(south, west, north, east) of a geohash; null for another string."""
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(False).alias("odd"))

    def step(a: Column, d: Column) -> Column:
        bit = lambda k: F.floor(d / (1 << k)) % 2
        even_x, even_y = a["x"] * 8 + bit(4) * 4 + bit(2) * 2 + bit(0), a["y"] * 4 + bit(3) * 2 + bit(1)
        odd_x, odd_y = a["x"] * 4 + bit(3) * 2 + bit(1), a["y"] * 8 + bit(4) * 4 + bit(2) * 2 + bit(0)
        return F.struct(
            F.when(a["odd"], odd_x).otherwise(even_x).cast("bigint").alias("x"), F.when(a["odd"], odd_y).otherwise(even_y).cast("bigint").alias("y"), (~a["odd"]).alias("odd")
        )

    def read(low: Column) -> Column:
        digits = F.transform(F.filter(F.split(low, ""), lambda d: d != ""), lambda d: F.instr(F.lit(GEOHASH), d) - 1)
        n = F.length(low) * 5
        w, h = F.lit(360.0) / F.pow(F.lit(2.0), F.ceil(n / 2)), F.lit(180.0) / F.pow(F.lit(2.0), F.floor(n / 2))
        return F.when(low.rlike(f"^[{GEOHASH}]{{1,12}}$"), let(F.struct(F.aggregate(digits, start, step).alias("end"), w.alias("w"), h.alias("h")), box))

    def box(q: Column) -> Column:
        south, west = q["end"]["y"] * q["h"] - 90.0, q["end"]["x"] * q["w"] - 180.0
        return F.struct(south.alias("south"), west.alias("west"), (south + q["h"]).alias("north"), (west + q["w"]).alias("east"))

    return let(F.lower(F.trim(code)), read)


def maidenhead(lat: Num, lon: Num, pairs: int) -> Column:
    """Locator of 1 to 3 pairs."""
    if not 1 <= pairs <= 3:
        raise ValueError(pairs)
    x, y = wrap_longitude(lon) + 180.0, clamp_latitude(lat) + 90.0
    out = []
    for (wide, high), top, first in zip(((20.0, 10.0), (2.0, 1.0), (1 / 12.0, 1 / 24.0)), (17, 9, 23), ("A", "0", "a")[:pairs]):
        i, j = F.least(F.floor(x / wide), F.lit(top)), F.least(F.floor(y / high), F.lit(top))
        out += [F.char(i + ord(first)), F.char(j + ord(first))]
        x, y = x - i * wide, y - j * high
    return F.concat(*out)


def plus_code(lat: Num, lon: Num, length: int) -> Column:
    """Open location code of 2, 4, 6, 8 or 10 to 15 digits; short ones are padded with zeros."""
    if length not in (2, 4, 6, 8, *range(10, 16)):
        raise ValueError(length)
    rows, cols = 5**5, 4**5
    lat_units, lon_units = 180 * 8000 * rows, 360 * 8000 * cols
    y = F.floor(clamp_latitude(lat) * float(8000 * rows)).cast("bigint") + lat_units // 2
    y = F.greatest(F.least(y, F.lit(lat_units - 1)), F.lit(0))
    x = (F.floor(wrap_longitude(lon) * float(8000 * cols)).cast("bigint") + lon_units // 2) % lon_units

    def code(p: Column) -> Column:
        y, x, digits = p["y"], p["x"], []
        for k in range(5):
            digits += [_digit(PLUS, F.floor(v / F.lit(unit * 20 ** (4 - k))) % 20) for v, unit in ((y, rows), (x, cols))]
        for k in range(max(0, length - 10)):
            r, s = F.floor(y / F.lit(5 ** (4 - k))) % 5, F.floor(x / F.lit(4 ** (4 - k))) % 4
            digits.append(_digit(PLUS, r * 4 + s))
        shown = [*digits[: min(length, 8)], *[F.lit("0")] * max(0, 8 - length)]
        return F.concat(*shown, F.lit("+"), *digits[8:length])

    return let(F.struct(y.alias("y"), x.alias("x")), code)


def utm_zone(lat: Num, lon: Num) -> Column:
    """Zone 1 to 60 with the exceptions of south-west Norway and Svalbard; null outside [-80, 84)."""

    def zone(p: Column) -> Column:
        lat, lon = p["lat"], p["lon"]
        plain = F.floor((lon + 180.0) / 6.0).cast("int") + 1
        svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
        return F.when(
            (lat >= -80) & (lat < 84),
            F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain),
        )

    return let(F.struct(c(lat).alias("lat"), wrap_longitude(lon).alias("lon")), zone)


def utm_central_meridian(zone: Num) -> Column:
    """Degrees of longitude of a zone's middle; null outside 1 to 60."""
    zone = c(zone)
    return F.when(zone.between(1, 60), zone * 6.0 - 183.0)


def kruger(crs: str = WGS84) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the fourth-order series to and from the rectifying sphere, in the third flattening."""
    e = ELLIPSOIDS[crs]
    n = e.f / (2.0 - e.f)
    radius = e.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, back


def utm(lat: Num, lon: Num, zone: Column | None = None, crs: str = WGS84) -> Column:
    """STRUCT<zone, hemi, easting_m, northing_m> by the Krüger series; null outside [-80, 84)."""
    e = ELLIPSOIDS[crs]
    radius, alpha, _ = kruger(crs)
    ecc = e.e2**0.5
    given = F.struct(c(lat).alias("lat"), wrap_longitude(lon).alias("lon"), (F.lit(None).cast("int") if zone is None else zone).alias("zone"))

    def conformal(p: Column) -> Column:
        s = F.sin(F.radians(p["lat"]))
        of = lambda s: F.sinh(F.atanh(s) - F.atanh(s * ecc) * ecc)
        dl = F.radians(wrap_longitude(p["lon"] - (p["zone"] * 6 - 183)))
        return let(F.struct(let(s, of).alias("t"), dl.alias("dl")), project)

    def project(v: Column) -> Column:
        xi, eta = F.atan2(v["t"], F.cos(v["dl"])), F.asinh(F.sin(v["dl"]) / F.hypot(v["t"], F.cos(v["dl"])))
        return let(F.struct(xi.alias("xi"), eta.alias("eta")), series)

    def series(q: Column) -> Column:
        x, y = q["eta"], q["xi"]
        for k, a in enumerate(alpha, 1):
            x = x + F.cos(q["xi"] * (2 * k)) * F.sinh(q["eta"] * (2 * k)) * a
            y = y + F.sin(q["xi"] * (2 * k)) * F.cosh(q["eta"] * (2 * k)) * a
        return F.struct((x * (0.9996 * radius)).alias("x"), (y * (0.9996 * radius)).alias("y"))

    def place(p: Column, q: Column) -> Column:
        return F.struct(
            p["zone"].alias("zone"), F.when(p["lat"] >= 0, "N").otherwise("S").alias("hemi"), (q["x"] + 500000.0).alias("easting_m"),
            F.when(p["lat"] >= 0, q["y"]).otherwise(q["y"] + 10000000.0).alias("northing_m"),
        )

    placed = lambda p: F.when(p["zone"].isNotNull(), let(conformal(p), lambda q: place(p, q)))
    if zone is None:
        return let(let(given, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), utm_zone(p["lat"], p["lon"]).alias("zone"))), placed)
    return let(given, placed)


def latitude_of_conformal(target: Column, crs: str = WGS84) -> Column:
    """Degrees of latitude whose conformal latitude has that tangent, by Newton's method, four steps."""
    e = ELLIPSOIDS[crs]
    ecc = e.e2**0.5
    def step(t: Column, target: Column) -> Column:
        def moved(r: Column) -> Column:
            root, sigma = r["root"], r["sigma"]
            slope = (t * t * (1.0 - e.e2) + 1.0) / (root * (1.0 - e.e2))
            return let(t * F.sqrt(sigma * sigma + 1.0) - sigma * root, lambda at: t + (target - at) / F.sqrt(at * at + 1.0) * slope)

        sized = lambda root: F.struct(root.alias("root"), F.sinh(F.atanh(t / root * ecc) * ecc).alias("sigma"))
        return let(let(F.sqrt(t * t + 1.0), sized), moved)

    solved = lambda target: F.aggregate(F.array_repeat(target, 4), target / (1.0 - e.e2), step)
    return F.degrees(F.atan(let(target, solved)))


def utm_inverse(u: Column, crs: str = WGS84) -> Column:
    """(lat, lon) of a UTM struct; the latitude from its conformal one by Newton's method, four steps."""
    radius, _, beta = kruger(crs)

    def plane(u: Column) -> Column:
        y = F.when(u["hemi"] == "N", u["northing_m"]).otherwise(u["northing_m"] - 10000000.0) / (0.9996 * radius)
        x = (u["easting_m"] - 500000.0) / (0.9996 * radius)
        return let(let(let(F.struct(x.alias("x"), y.alias("y")), rectified), sides), lambda q: place(u, q))

    def rectified(q: Column) -> Column:
        x, y = q["x"], q["y"]
        xi, eta = y, x
        for k, b in enumerate(beta, 1):
            xi = xi - F.sin(y * (2 * k)) * F.cosh(x * (2 * k)) * b
            eta = eta - F.cos(y * (2 * k)) * F.sinh(x * (2 * k)) * b
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    sides = lambda q: F.struct(F.sin(q["xi"]).alias("s"), F.cos(q["xi"]).alias("c"), F.sinh(q["eta"]).alias("h"))

    def place(u: Column, q: Column) -> Column:
        lon = wrap_longitude(F.degrees(F.atan2(q["h"], q["c"])) + (u["zone"] * 6 - 183))
        return F.struct(latitude_of_conformal(q["s"] / F.hypot(q["h"], q["c"]), crs).alias("lat"), lon.alias("lon"))

    return let(u, plane)


def s2_level(cell: Column) -> Column:
    """Level of an S2 cell id, from its lowest set bit."""
    low = cell.bitwiseAND(-cell)
    return F.lit(30) - (F.length(F.bin(low)) - 1) / 2


def h3_resolution(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 52).bitwiseAND(15).cast("int")


# The letters of MGRS bands, of columns (three sets in turn) and of rows.
BANDS, COLUMNS, ROWS = "CDEFGHJKLMNPQRSTUVWX", ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ"), "ABCDEFGHJKLMNPQRSTUV"


def mgrs(lat: Num, lon: Num, digits: int = 5) -> Column:
    """MGRS reference with 0 to 5 digits for each axis, cut and not rounded; beyond [-80, 84) in the polar letters."""
    if not 0 <= digits <= 5:
        raise ValueError(digits)

    def code(lat: Column, u: Column) -> Column:
        band = F.least(F.floor((lat + 80.0) / 8.0), F.lit(19))
        e, n = F.floor(u["easting_m"]).cast("bigint"), F.floor(u["northing_m"]).cast("bigint")
        turn = (u["zone"] - 1) % 3
        column = F.substring(F.lit("".join(COLUMNS)), (turn * 8 + F.floor(e / 100000)).cast("int"), F.lit(1))
        row = _digit(ROWS, (F.floor(n / 100000) + F.when(u["zone"] % 2 == 0, 5).otherwise(0)) % 20)
        part = lambda v: F.lpad(F.floor(v % 100000 / 10 ** (5 - digits)).cast("string"), digits, "0")
        return F.concat(F.lpad(u["zone"].cast("string"), 2, "0"), _digit(BANDS, band), column, row, *([part(e), part(n)] if digits else []))

    from geoloom.functions.codes import mgrs_polar

    def named(p: Column) -> Column:
        lat, lon = p["lat"], p["lon"]
        return F.when((lat >= -80) & (lat < 84), let(utm(lat, lon), lambda u: code(lat, u))).when(lat.between(-90, 90), mgrs_polar(lat, lon, digits))

    return let(F.struct(c(lat).alias("lat"), c(lon).alias("lon")), named)


# Place on the Hilbert curve of the quarters (0,0), (0,1), (1,0), (1,1) in each of four orientations, and how
# a place changes the orientation.
CURVE, TURN = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0)), (1, 0, 0, 3)


def _faces(x: Column, y: Column, z: Column) -> Column:
    """Face of the cube and the place (u, v) on it of a direction."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    side = lambda f, u, v: F.struct(F.lit(f).alias("face"), u.alias("u"), v.alias("v"))
    on_x = F.when(x >= 0, side(0, y / x, z / x)).otherwise(side(3, z / x, y / x))
    on_y = F.when(y >= 0, side(1, -x / y, z / y)).otherwise(side(4, z / y, -x / y))
    on_z = F.when(z >= 0, side(2, -x / z, -y / z)).otherwise(side(5, -y / z, -x / z))
    return F.when((ax > ay) & (ax > az), on_x).when(ay > az, on_y).otherwise(on_z)


def s2_grid(lat: Num, lon: Num) -> Column:
    """STRUCT<face, i, j>: the face of the cube that a point is on, and its place there in units of the finest cells."""
    p, l = F.radians(c(lat)), F.radians(c(lon))
    direction = F.struct((F.cos(p) * F.cos(l)).alias("x"), (F.cos(p) * F.sin(l)).alias("y"), F.sin(p).alias("z"))
    square = lambda u: F.when(u >= 0, F.sqrt(u * 3.0 + 1.0) * 0.5).otherwise(F.lit(1.0) - F.sqrt(F.lit(1.0) - u * 3.0) * 0.5)
    cell = lambda u: F.greatest(F.least(F.floor(square(u) * float(1 << 30)), F.lit((1 << 30) - 1)), F.lit(0)).cast("bigint")
    grid = lambda f: F.struct(f["face"].alias("face"), cell(f["u"]).alias("i"), cell(f["v"]).alias("j"))
    return let(let(direction, lambda d: _faces(d["x"], d["y"], d["z"])), grid)


def _curve(levels: int) -> tuple[list[int], list[int]]:
    """Place on the curve and turn after so many levels, by turn and the quarters' bits of i and of j."""
    place, turn, n = [], [], 1 << levels
    for start in range(4):
        for k in range(n * n):
            i, j, at, now = k // n, k % n, 0, start
            for bit in range(levels - 1, -1, -1):
                step = CURVE[now][(i >> bit & 1) * 2 + (j >> bit & 1)]
                at, now = at * 4 + step, now ^ TURN[step]
            place.append(at)
            turn.append(now)
    return place, turn


def s2_id(grid: Column, level: int) -> Column:
    """Id of the cell of ``level`` at a place of :func:`s2_grid`."""
    if not 0 <= level <= 30:
        raise ValueError(level)
    state = F.struct(grid["face"].cast("bigint").alias("id"), grid["face"].bitwiseAND(1).alias("turn"))

    def walked(state: Column, wide: int, downs: list[int]) -> Column:
        """``wide`` levels a step, the last of each ``downs`` above the finest."""
        places, turns = (F.array(*[F.lit(v) for v in row]) for row in _curve(wide))

        def step(state: Column, down: Column) -> Column:
            bits = lambda v: F.call_function("shiftright", v, down).bitwiseAND((1 << wide) - 1).cast("int")
            key = F.shiftleft(state["turn"], 2 * wide) + F.shiftleft(bits(grid["i"]), wide) + bits(grid["j"])
            return let(key, lambda k: F.struct((F.shiftleft(state["id"], 2 * wide) + F.get(places, k)).alias("id"), F.get(turns, k).alias("turn")))

        return F.aggregate(F.array(*[F.lit(k) for k in downs]), state, step) if downs else state

    odd = level % 3
    state = walked(state, 1, [29 - k for k in range(odd)])
    state = walked(state, 3, [30 - odd - 3 * (k + 1) for k in range(level // 3)])
    return F.shiftleft(F.shiftleft(state["id"], 1).bitwiseOR(F.lit(1).cast("bigint")), 2 * (30 - level))


def s2_cell(lat: Num, lon: Num, level: int) -> Column:
    """Id of the S2 cell of level 0 to 30 that holds a point, as BIGINT with the bits of the unsigned id."""
    return let(s2_grid(lat, lon), lambda grid: s2_id(grid, level))
