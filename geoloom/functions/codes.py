"""Reading grid codes back: geohash, Maidenhead, Plus Code, UTM, UPS, MGRS, S2 and H3 ids, as Column expressions.

``parse_*`` bring a code to its canonical form, or null for a text that is none. ``*_decode`` give STRUCT<lat, lon, max_error_m>:
a cell's middle and the distance to its farthest corner.
"""

from __future__ import annotations

from math import exp, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import WGS84, Num, c, finite, let, wrap_longitude
from geoloom.functions.geodesy import ELLIPSOIDS, near_distance
from geoloom.functions.grids import (
    BANDS, COLUMNS, CURVE, GEOHASH, PLUS, ROWS, TURN, _faces, geohash_bounds, geohash_box, kruger, latitude_of_conformal, s2_level, utm, utm_inverse, utm_zone,
)


def _middle(b: Column) -> Column:
    return F.struct(((b["south"] + b["north"]) / 2.0).alias("lat"), ((b["west"] + b["east"]) / 2.0).alias("lon"))


#: What the distance formula may err by, as a factor and in metres.
SLACK, SLACK_M = 1.00002, 1e-6


def bounded(cell: Column, crs: str = WGS84) -> Column:
    """A cell's STRUCT<middle, corners> as its middle with the distance to the farthest corner."""
    far = F.array_max(F.transform(cell["corners"], lambda p: near_distance(cell["middle"]["lat"], cell["middle"]["lon"], p["lat"], p["lon"], crs)))
    return F.struct(cell["middle"]["lat"].alias("lat"), cell["middle"]["lon"].alias("lon"), (far * SLACK + SLACK_M).alias("max_error_m"))


def box_corners(b: Column) -> Column:
    """A box's western corners; the eastern ones are as far from its middle."""
    at = lambda lat, lon: F.struct(b[lat].alias("lat"), b[lon].alias("lon"))
    return F.array(*[at(y, "west") for y in ("south", "north")])


def _decoded(box: Column, crs: str) -> Column:
    cell = lambda b: F.when(b.isNotNull(), let(F.struct(_middle(b).alias("middle"), box_corners(b).alias("corners")), lambda v: bounded(v, crs)))
    return let(box, cell)


def parse_geohash(code: Column) -> Column:
    low = F.lower(F.trim(code))
    return F.when(low.rlike(f"^[{GEOHASH}]{{1,12}}$"), low)


def geohash_middle(cell: Column, length: int, crs: str = WGS84) -> Column:
    """:func:`geohash_decode` of a cell of :func:`geoloom.functions.grids.geohash_cell`."""
    return _decoded(geohash_box(cell, length), crs)


def geohash_decode(code: Column, crs: str = WGS84) -> Column:
    return _decoded(geohash_bounds(code), crs)


def parse_maidenhead(code: Column) -> Column:
    """Field in capitals, square in digits, subsquare in small letters."""
    text = F.trim(code)
    made = F.concat(F.upper(F.substring(text, 1, 2)), F.substring(text, 3, 2), F.lower(F.substring(text, 5, 2)))
    return F.when(text.rlike("^[A-Ra-r]{2}([0-9]{2}([A-Xa-x]{2})?)?$"), made)


def maidenhead_bounds(code: Column) -> Column:
    at = lambda x, k, first: F.ascii(F.substring(x, k, 1)) - ord(first)
    some = lambda x, k, first: F.when(F.length(x) >= k, at(x, k, first)).otherwise(0)

    def box(x: Column) -> Column:
        n = F.length(x)
        west = some(x, 1, "A") * 20.0 + some(x, 3, "0") * 2.0 + some(x, 5, "a") / 12.0 - 180.0
        south = some(x, 2, "A") * 10.0 + some(x, 4, "0") * 1.0 + some(x, 6, "a") / 24.0 - 90.0
        wide = F.when(n == 2, 20.0).when(n == 4, 2.0).otherwise(1 / 12.0)
        return F.struct(south.alias("south"), west.alias("west"), (south + wide / 2.0).alias("north"), (west + wide).alias("east"))

    return let(parse_maidenhead(code), lambda x: F.when(x.isNotNull(), box(x)))


def maidenhead_decode(code: Column, crs: str = WGS84) -> Column:
    return _decoded(maidenhead_bounds(code), crs)


def parse_plus_code(code: Column) -> Column:
    """A full open location code in capitals; short codes are none."""
    d = f"[{PLUS}]"
    start = f"[{PLUS[:9]}][{PLUS[:18]}]"
    full = rf"^{start}({d}{{6}}\+({d}{{2,7}})?|{d}{{4}}00\+|{d}{{2}}0000\+|000000\+)$"
    return let(F.upper(F.trim(code)), lambda text: F.when(text.rlike(full), text))


def plus_code_bounds(code: Column) -> Column:
    pairs, fine = range(5), range(5)
    weight = lambda y, x: F.struct(F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x"))
    weights = F.array(*[weight(3125 * 20 ** (4 - k), 1024 * 20 ** (4 - k)) for k in pairs], *[weight(5 ** (4 - k), 4 ** (4 - k)) for k in fine])

    def box(text: Column) -> Column:
        """A code in capitals has its digits at known places; what it lacks, and the zeros that pad it, count as none."""
        digit = lambda at: F.greatest(F.instr(F.lit(PLUS), F.substring(text, at, 1)) - 1, F.lit(0))
        n = F.when(F.instr(text, "0") > 0, F.instr(text, "0")).otherwise(F.length(text)) - 1
        by = lambda k, base, one: float(one * base ** (4 - k))
        y = x = F.lit(0.0)
        for k, at in zip(pairs, (1, 3, 5, 7, 10)):
            y, x = y + digit(at) * by(k, 20, 3125), x + digit(at + 1) * by(k, 20, 1024)
        last = F.get(weights, F.when(n <= 10, F.shiftright(n, 1)).otherwise(n - 5) - 1)
        read = F.struct(y.alias("y"), x.alias("x"), last.alias("last"), n.alias("n"), *[digit(12 + k).alias(f"d{k}") for k in fine])

        def refined(r: Column) -> Column:
            y, x = r["y"], r["x"]
            for k in fine:
                y, x = y + F.shiftright(r[f"d{k}"], 2) * by(k, 5, 1), x + r[f"d{k}"].bitwiseAND(3) * by(k, 4, 1)
            more = r["n"] > 10
            return F.struct(F.when(more, y).otherwise(r["y"]).alias("y"), F.when(more, x).otherwise(r["x"]).alias("x"), r["last"].alias("last"))

        up, across = 8000.0 * 3125, 8000.0 * 1024
        return let(
            let(read, refined),
            lambda e: F.struct(
                (e["y"] / up - 90.0).alias("south"), (e["x"] / across - 180.0).alias("west"),
                ((e["y"] + e["last"]["y"]) / up - 90.0).alias("north"), ((e["x"] + e["last"]["x"]) / across - 180.0).alias("east"),
            ),
        )

    return let(parse_plus_code(code), lambda x: F.when(x.isNotNull(), box(x)))


def plus_code_decode(code: Column, crs: str = WGS84) -> Column:
    return _decoded(plus_code_bounds(code), crs)


def utm_reference(zone: Num, hemi: Column, easting_m: Num, northing_m: Num, crs: str = WGS84) -> Column:
    """A UTM struct that some position has: null for a zone, hemisphere or place that its own position would not give."""
    made = F.struct(c(zone).cast("int").alias("zone"), hemi.alias("hemi"), c(easting_m).alias("easting_m"), c(northing_m).alias("northing_m"))
    ok = c(zone).between(1, 60) & hemi.isin("N", "S") & c(easting_m).between(100000, 900000) & c(northing_m).between(0, 10000000)

    def home(u: Column) -> Column:
        """``u`` where its position, or one a hair beside it, belongs to its zone."""
        zone = lambda p, d: utm_zone(p["lat"], p["lon"] + d) == u["zone"]
        side = lambda p: (F.abs(p["lat"]) < 1e-9) | (F.when(p["lat"] < 0, "S").otherwise("N") == u["hemi"])
        return let(utm_inverse(u, crs), lambda p: F.when(side(p) & (zone(p, 1e-9) | zone(p, -1e-9)), u))

    return F.when(ok, let(made, home))


def _polar_scale(crs: str) -> float:
    e = ELLIPSOIDS[crs]
    ecc = e.e2**0.5
    return 2.0 * e.a * 0.994 / ((1 + ecc) ** (1 + ecc) * (1 - ecc) ** (1 - ecc)) ** 0.5


def ups(lat: Num, lon: Num, crs: str = WGS84) -> Column:
    """STRUCT<hemi, easting_m, northing_m> of the polar areas: from 84 degrees north and south of 80; else null."""
    lat, ecc = c(lat), ELLIPSOIDS[crs].e2 ** 0.5
    s = F.sin(F.radians(F.abs(lat)))
    # The tangent of half the conformal colatitude, from the angle to the pole so that it keeps its digits there.
    half = F.tan(F.radians(F.lit(90.0) - F.abs(lat)) / 2.0) * F.exp(F.atanh(s * ecc) * ecc)
    l = F.radians(c(lon))

    def place(rho: Column) -> Column:
        up = F.cos(l) * rho
        return F.struct(
            F.when(lat > 0, "N").otherwise("S").alias("hemi"), (F.sin(l) * rho + 2000000.0).alias("easting_m"), F.when(lat > 0, F.lit(2000000.0) - up).otherwise(up + 2000000.0).alias("northing_m")
        )

    return F.when((lat >= 84) | (lat < -80), let(half * _polar_scale(crs), place))


def ups_inverse(u: Column, crs: str = WGS84) -> Column:
    """(lat, lon) of a UPS struct; the pole has the longitude 0."""
    x, north = u["easting_m"] - 2000000.0, u["hemi"] == "N"
    y = F.when(north, F.lit(2000000.0) - u["northing_m"]).otherwise(u["northing_m"] - 2000000.0)
    ecc = ELLIPSOIDS[crs].e2 ** 0.5

    def back(half: Column) -> Column:
        # Fixed point on the angle to the pole; the factor differs from 1 by less than a hundredth.
        step = lambda z, _: F.atan(half * F.exp(-F.atanh(F.cos(z) * ecc) * ecc)) * 2.0
        z = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.atan(half * exp(-ecc * ecc)) * 2.0, step)
        lat = F.lit(90.0) - F.degrees(z)
        lon = F.when(half == 0, F.lit(0.0)).otherwise(wrap_longitude(F.degrees(F.atan2(x, y))))
        return F.struct(F.when(north, lat).otherwise(-lat).alias("lat"), lon.alias("lon"))

    return let(F.hypot(x, y) / _polar_scale(crs), back)


def ups_reference(hemi: Column, easting_m: Num, northing_m: Num, crs: str = WGS84) -> Column:
    """A UPS struct whose position lies in its polar area; else null."""
    made = F.struct(hemi.alias("hemi"), c(easting_m).alias("easting_m"), c(northing_m).alias("northing_m"))
    inside = lambda u: let(ups_inverse(u, crs), lambda p: F.when((p["lat"] >= 84 - 1e-9) | (p["lat"] < -80 + 1e-9), u))
    return F.when(hemi.isin("N", "S") & finite(easting_m) & finite(northing_m), let(made, inside))


# The letters of the polar squares; first column and row are numbered in units of 100 km.
POLAR = {
    "A": ("JKLPQRSTUXYZ", 8, "ABCDEFGHJKLMNPQRSTUVWXYZ", 8), "B": ("ABCFGHJKLPQR", 20, "ABCDEFGHJKLMNPQRSTUVWXYZ", 8),
    "Y": ("RSTUXYZ", 13, "ABCDEFGHJKLMNP", 13), "Z": ("ABCFGHJ", 20, "ABCDEFGHJKLMNP", 13),
}


def mgrs_polar(lat: Num, lon: Num, digits: int = 5) -> Column:
    """MGRS reference in the polar areas; null elsewhere."""

    def code(u: Column) -> Column:
        e, n = F.floor(u["easting_m"]).cast("bigint"), F.floor(u["northing_m"]).cast("bigint")
        east = e >= 2000000
        part = lambda v: F.lpad(F.floor(v % 100000 / 10 ** (5 - digits)).cast("string"), digits, "0")

        def square(zone: str) -> Column:
            columns, first, rows, low = POLAR[zone]
            letter = lambda s, v, start: F.substring(F.lit(s), (F.floor(v / 100000) - start + 1).cast("int"), F.lit(1))
            return F.concat(F.lit(zone), letter(columns, e, first), letter(rows, n, low))

        north = u["hemi"] == "N"
        name = F.when(north & east, square("Z")).when(north, square("Y")).when(east, square("B")).otherwise(square("A"))
        return F.concat(name, *([part(e), part(n)] if digits else []))

    return let(ups(lat, lon), lambda u: F.when(u.isNotNull(), code(u)))


def mgrs_side(digits: int) -> float:
    """Metres of the side of a square with that many digits for each axis."""
    if not 0 <= digits <= 5:
        raise ValueError(digits)
    return 10.0 ** (5 - digits)


def _meridian_northing(lat: float) -> float:
    """Northing on a zone's middle, with the south's false northing."""
    from math import asin, atan, atanh, radians, sin, sinh, tan

    radius, alpha, _ = kruger()
    ecc = ELLIPSOIDS[WGS84].e2 ** 0.5
    s = sin(radians(lat))
    chi = atan(sinh(atanh(s) - ecc * atanh(ecc * s)))
    y = 0.9996 * radius * (chi + sum(a * sin(2 * k * chi) for k, a in enumerate(alpha, 1)))
    return y if lat >= 0 else y + 10000000.0


def _zone_edges(zone: Column, band: Column) -> Column:
    """West and east edge in degrees of a zone in a band, with the exceptions of Norway and Svalbard; null where it has none."""
    arc = lambda w, e: F.struct(F.lit(float(w)).alias("west"), F.lit(float(e)).alias("east"))
    plain = F.struct((zone * 6.0 - 186.0).alias("west"), (zone * 6.0 - 180.0).alias("east"))
    none = F.lit(None).cast("struct<west:double,east:double>")
    odd = {("V", 31): arc(0, 3), ("V", 32): arc(3, 12), ("X", 31): arc(0, 9), ("X", 33): arc(9, 21), ("X", 35): arc(21, 33), ("X", 37): arc(33, 42)}
    out = F.when((band == "X") & zone.isin(32, 34, 36), none)
    for (letter, number), edges in odd.items():
        out = out.when((band == letter) & (zone == number), edges)
    return out.otherwise(plain)


def _mgrs_text(code: Column) -> Column:
    return let(F.upper(F.regexp_replace(code, r"\s", "")), lambda text: F.when(text.rlike("^[0-9][A-Z]"), F.concat(F.lit("0"), text)).otherwise(text))


def mgrs_decode(code: Column, crs: str = WGS84) -> Column:
    """STRUCT<lat, lon, max_error_m, code> of an MGRS reference with 0 to 5 digits an axis; null for a text that is none.

    The middle of the square; where the square is cut by its zone or band, the middle moved to the cut, with the square's
    diagonal as bound. A square no part of which belongs to its zone is none. ``code`` is the canonical form.
    """
    pattern = r"^(?:([0-9]{2})([C-HJ-NP-X])|([ABYZ]))([A-HJ-NP-Z])([A-HJ-NP-V]|(?<=^[ABYZ][A-Z])[A-HJ-NP-Z])((?:[0-9]{2}){0,5})$"
    lowest = F.array(*[F.lit((_meridian_northing(-80.0 + 8 * k) - 150000.0)) for k in range(20)])

    def parts(text: Column) -> Column:
        get = lambda k: F.regexp_extract(text, pattern, k)
        return F.struct(
            text.alias("text"), get(1).try_cast("int").alias("zone"), get(2).alias("band"), get(3).alias("polar"), get(4).alias("col"), get(5).alias("row"),
            get(6).alias("digits"), (F.length(get(6)) / 2).cast("int").alias("n"), F.rpad(get(6), 10, "0").alias("padded"),
        )

    def sized(p: Column) -> Column:
        side = F.pow(F.lit(10.0), F.lit(5) - p["n"])
        part = lambda first: F.when(p["n"] == 0, 0.0).otherwise(F.substr(p["digits"], F.when(F.lit(first), F.lit(1)).otherwise(p["n"] + 1), p["n"]).cast("double") * side)
        return F.struct(side.alias("side"), (part(True) + side / 2.0).alias("e"), (part(False) + side / 2.0).alias("n"))

    def in_utm(p: Column, s: Column) -> Column:
        number = F.instr(F.lit(BANDS), p["band"]) - 1
        turn = (p["zone"] - 1) % 3
        column = F.instr(F.lit("".join(COLUMNS)), p["col"]) - turn * 8
        row = F.pmod(F.instr(F.lit(ROWS), p["row"]) - 1 - F.when(p["zone"] % 2 == 0, 5).otherwise(0), F.lit(20)) * 100000.0
        low = F.get(lowest, number)
        northing = F.ceil((low - row) / 2000000.0) * 2000000.0 + row + s["n"]
        ref = F.struct(p["zone"].alias("zone"), F.when(number >= 10, "N").otherwise("S").alias("hemi"), (column * 100000.0 + s["e"]).alias("easting_m"), northing.alias("northing_m"))
        south = number * 8.0 - 80.0
        north = F.when(number == 19, 84.0).otherwise(south + 8.0)
        ok = column.between(1, 8) & p["zone"].between(1, 60)

        def settle(q: Column) -> Column:
            mid = p["zone"] * 6.0 - 183.0
            lon = wrap_longitude(q["p"]["lon"] - mid) + mid
            lat = F.least(F.greatest(q["p"]["lat"], south), north - 1e-9)

            def moved(m: Column) -> Column:
                bound = F.when(m["cut"], s["side"]).otherwise(s["side"] / 2.0) * (2.0**0.5 / 0.9994)
                point = F.struct(m["lat"].alias("lat"), m["lon"].alias("lon"), bound.alias("max_error_m"), p["text"].alias("code"))
                # A cut square still has to hold the point that it was moved to.
                off = lambda v: F.greatest(F.abs(v["easting_m"] - q["ref"]["easting_m"]), F.abs(v["northing_m"] - q["ref"]["northing_m"]))
                back = let(utm(m["lat"], m["lon"], p["zone"], crs), lambda v: off(v) <= s["side"] / 2.0 + 0.01)
                return F.when(~m["cut"] | back, point)

            def kept(v: Column) -> Column:
                inside = F.least(F.greatest(v["lon"], q["zone"]["west"]), q["zone"]["east"] - 1e-9)
                cut = (v["lat"] != q["p"]["lat"]) | (inside != v["lon"])
                return let(F.struct(v["lat"].alias("lat"), wrap_longitude(inside).alias("lon"), cut.alias("cut")), moved)

            return let(F.struct(lat.alias("lat"), lon.alias("lon")), kept)

        found = let(ref, lambda r: F.struct(r.alias("ref"), utm_inverse(r, crs).alias("p"), _zone_edges(p["zone"], p["band"]).alias("zone")))
        return F.when(ok, let(found, lambda q: F.when(q["zone"].isNotNull(), settle(q))))

    def in_ups(p: Column, s: Column) -> Column:
        def square(zone: str) -> Column:
            columns, first, rows, low = POLAR[zone]
            x, y = F.instr(F.lit(columns), p["col"]) - 1, F.instr(F.lit(rows), p["row"]) - 1
            at = F.struct(F.lit("N" if zone in "YZ" else "S").alias("hemi"), ((x + first) * 100000.0 + s["e"]).alias("easting_m"), ((y + low) * 100000.0 + s["n"]).alias("northing_m"))
            return F.when((x >= 0) & (y >= 0), at)

        which = F.when(p["polar"] == "A", square("A")).when(p["polar"] == "B", square("B")).when(p["polar"] == "Y", square("Y")).otherwise(square("Z"))

        def settle(g: Column) -> Column:
            edge = F.when(p["polar"].isin("Y", "Z"), F.greatest(g["lat"], F.lit(84.0))).otherwise(F.least(g["lat"], F.lit(-80.0 - 1e-9)))
            cut = edge != g["lat"]
            bound = F.when(cut, s["side"]).otherwise(s["side"] / 2.0) * (2.0**0.5 / 0.99)
            return F.when(F.abs(edge - g["lat"]) * 111000.0 <= bound, F.struct(edge.alias("lat"), g["lon"].alias("lon"), bound.alias("max_error_m"), p["text"].alias("code")))

        return let(which, lambda u: F.when(u.isNotNull(), let(ups_inverse(u, crs), settle)))

    def read(p: Column) -> Column:
        return let(sized(p), lambda s: F.when(p["polar"] != "", in_ups(p, s)).otherwise(in_utm(p, s)))

    return let(_mgrs_text(code), lambda t: F.when(t.rlike(pattern), let(parts(t), read)))


def parse_mgrs(code: Column) -> Column:
    return mgrs_decode(code)["code"]


def s2_cell_id(value: Column) -> Column:
    """A BIGINT with the bits of an S2 cell id; null for bits that are none."""
    low = value.bitwiseAND(-value)
    even = low.bitwiseAND(F.lit(0x1555555555555555)) != 0
    return F.when((F.shiftrightunsigned(value, 61) <= 5) & even, value)


def _s2_vector(face: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    one = F.lit(1.0)
    axes = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)]
    out = []
    for k in range(3):
        x = axes[5][k]
        for f in range(4, -1, -1):
            x = F.when(face == f, axes[f][k]).otherwise(x)
        out.append(x)
    return tuple(out)


def _s2_place(q: Column, bound: bool) -> Column:
    """Middle and corners, or with no ``bound`` the middle, of a cell's STRUCT<face, size, at>: its side and its place in units of that."""
    flat = lambda x: F.when(x >= 0.5, (x * x * 4.0 - 1.0) / 3.0).otherwise((F.lit(1.0) - (F.lit(1.0) - x) * (F.lit(1.0) - x) * 4.0) / 3.0)
    spots = (0.0, 0.5, 1.0) if bound else (0.5,)

    def point(w: Column, dx: float, dy: float) -> Column:
        axes = F.struct(*[x.alias(k) for k, x in zip("xyz", _s2_vector(w["face"], w[f"u{dx}"], w[f"v{dy}"]))])
        return let(axes, lambda p: F.struct(F.degrees(F.atan2(p["z"], F.hypot(p["x"], p["y"]))).alias("lat"), wrap_longitude(F.degrees(F.atan2(p["y"], p["x"]))).alias("lon")))

    def seen(w: Column) -> Column:
        middle = point(w, 0.5, 0.5)
        return F.struct(middle.alias("middle"), F.array(*[point(w, x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)]).alias("corners")) if bound else middle

    place = lambda w: F.struct(w["face"].alias("face"), *[flat(w[f"{k}{d}"]).alias(f"{k}{d}") for k in "uv" for d in spots])
    side = F.struct(q["face"].alias("face"), *[((q["at"][a] + d) * q["size"]).alias(f"{k}{d}") for k, a in (("u", "i"), ("v", "j")) for d in spots])
    return let(let(side, place), seen)


def s2_middle(grid: Column, level: int, crs: str = WGS84) -> Column:
    """:func:`s2_decode` of the cell of ``level`` at a place of :func:`geoloom.functions.grids.s2_grid`."""
    at = F.struct(*[F.shiftright(grid[k], 30 - level).alias(k) for k in "ij"])
    return let(let(F.struct(grid["face"].alias("face"), at.alias("at"), F.lit(0.5**level).alias("size")), lambda q: _s2_place(q, True)), lambda x: bounded(x, crs))


def s2_decode(cell: Column, crs: str = WGS84, bound: bool = True) -> Column:
    """The middle of an S2 cell, and with ``bound`` the distance to its farthest corner; null for bits that are none."""
    inverse = [[row.index(place) for place in range(4)] for row in CURVE]
    quarters, turns = F.array(*[F.lit(v) for row in inverse for v in row]), F.array(*[F.lit(v) for v in TURN])

    def walk(id_: Column) -> Column:
        face = F.shiftrightunsigned(id_, 61).cast("int")
        start = F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), face.bitwiseAND(1).alias("turn"))

        def step(a: Column, k: Column) -> Column:
            place = F.call_function("shiftrightunsigned", id_, k * 2 + 1).bitwiseAND(3).cast("int")
            ahead = lambda at: let(F.get(quarters, a["turn"] * 4 + at), lambda q: F.struct((a["i"] * 2 + F.floor(q / 2)).cast("bigint").alias("i"), (a["j"] * 2 + q % 2).cast("bigint").alias("j"), a["turn"].bitwiseXOR(F.get(turns, at)).alias("turn")))
            return let(place, ahead)

        level = s2_level(id_).cast("int")
        levels = F.when(level > 0, F.transform(F.sequence(F.lit(1), level), lambda k: F.lit(30) - k)).otherwise(F.array().cast("array<int>"))
        return let(
            F.struct(F.aggregate(levels, start, step).alias("at"), F.pow(F.lit(0.5), level).alias("size"), face.alias("face")),
            place,
        )

    place = lambda q: _s2_place(q, bound)
    seen = (lambda v: let(walk(v), lambda x: bounded(x, crs))) if bound else walk
    return let(s2_cell_id(cell), lambda v: F.when(v.isNotNull(), seen(v)))


# The base cells of H3 that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def h3_cell_id(value: Column) -> Column:
    """A BIGINT that is an H3 cell index; null for other bits: mode, base cell, a digit for each resolution, then sevens, and on a
    pentagon no first step along the missing axis."""
    bits = lambda shift, mask: F.shiftrightunsigned(value, shift).bitwiseAND(mask).cast("int")
    res, base = bits(52, 15), bits(45, 127)
    digits = F.array(*[bits(3 * (15 - r), 7) for r in range(1, 16)])
    fits = lambda d, k: F.when(k < res, d != 7).otherwise(d == 7)
    first = F.get(F.filter(digits, lambda d: (d != 0) & (d != 7)), 0)
    ok = (value >= 0) & (bits(59, 15) == 1) & (bits(56, 7) == 0) & (base <= 121) & F.forall(F.transform(digits, fits), lambda x: x)
    return F.when(ok & ~(base.isin(*PENTAGONS) & F.coalesce(first == 1, F.lit(False))), value)
