"""Coordinates, heights, error bounds, units and angles as Column expressions.

A coordinate is ``STRUCT<lat, lon, height_m, height_kind, crs>``, latitude first. Constructors give null where the
reference semantics reject a value (NaN, infinite or out of range), unless ``strict`` asks for an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84, GCJ02, BD09 = "WGS84", "GCJ-02", "BD-09"
NAD27, TOKYO, PULKOVO = "NAD27", "Tokyo", "Pulkovo-1942"
CRS = (WGS84, GCJ02, BD09, NAD27, TOKYO, PULKOVO)

# Metres per unit.
METERS_PER_UNIT = {
    "m": 1.0, "km": 1000.0, "ft": 0.3048, "us_ft": 1200.0 / 3937.0, "nmi": 1852.0, "mi": 1609.344, "yd": 0.9144,
}

Num = Column | str | float | int


def c(x: Num) -> Column:
    """A column: names are looked up, numbers become doubles."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, however often ``then`` uses it.

    A Column used n times is written out n times in the plan; nested uses multiply.
    """
    return F.get(F.transform(F.array(value), then), 0)


def finite(x: Num) -> Column:
    return c(x).isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) != float("inf"))


def checked(value: Column, ok: Column, strict: bool = False, what: str = "value out of range") -> Column:
    """``value`` where ``ok``; else null, or an error if ``strict``."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)) if strict else F.lit(None))


def coordinate(lat: Num, lon: Num, crs: str = WGS84, strict: bool = False) -> Column:
    """A validated point: closed ranges of 90 and 180 degrees, minus zero stored as zero, nothing wrapped."""
    lat, lon = c(lat), c(lon)
    point = F.struct(
        (lat + 0.0).alias("lat"), (lon + 0.0).alias("lon"), F.lit(None).cast("double").alias("height_m"),
        F.lit(None).cast("string").alias("height_kind"), F.lit(crs).alias("crs"),
    )
    return checked(point, lat.between(-90, 90) & lon.between(-180, 180), strict, "coordinate out of range")


def from_lon_lat(lon: Num, lat: Num, crs: str = WGS84, strict: bool = False) -> Column:
    return coordinate(lat, lon, crs, strict)


def wgs84(lat: Num, lon: Num) -> Column:
    return coordinate(lat, lon, WGS84)


def gcj02(lat: Num, lon: Num) -> Column:
    return coordinate(lat, lon, GCJ02)


def bd09(lat: Num, lon: Num) -> Column:
    return coordinate(lat, lon, BD09)


def with_height(point: Column, meters: Num, kind: str) -> Column:
    """Attach a finite height, ``ellipsoidal`` or ``orthometric``; a height that is not finite gives null."""
    if kind not in ("ellipsoidal", "orthometric"):
        raise ValueError(kind)
    return checked(point.withField("height_m", c(meters)).withField("height_kind", F.lit(kind)), finite(meters))


def is_null_island(lat: Num, lon: Num) -> Column:
    return (F.abs(c(lat)) <= 1e-6) & (F.abs(c(lon)) <= 1e-6)


def approx(value: Column, max_error_m: Num) -> Column:
    """A value with an error bound, which may be infinite but neither negative nor NaN."""
    bound = c(max_error_m)
    return checked(F.struct(value.alias("value"), bound.alias("max_error_m")), (bound >= 0) & ~F.isnan(bound))


def from_unit(value: Num, unit: str) -> Column:
    return c(value) * F.lit(METERS_PER_UNIT[unit])


def to_unit(meters: Num, unit: str) -> Column:
    return c(meters) / F.lit(METERS_PER_UNIT[unit])


def accuracy(kind: str, horizontal_m: Num | None = None, vertical_m: Num | None = None) -> Column:
    """Accuracy of an observation: at least one of the two, finite and not negative; else null."""
    if kind not in ("Bound", "OneSigma", "Cep50", "Unspecified"):
        raise ValueError(kind)
    none = F.lit(None).cast("double")
    h, v = (none if x is None else c(x) for x in (horizontal_m, vertical_m))
    fine = lambda x: x.isNull() | (finite(x) & (x >= 0))
    return checked(
        F.struct(F.lit(kind).alias("kind"), h.alias("horizontal_m"), v.alias("vertical_m")), fine(h) & fine(v) & (h.isNotNull() | v.isNotNull())
    )


def fix(coord: Column, acc: Column | None = None, ts: Column | None = None, source: Column | None = None) -> Column:
    """An observation from a bare coordinate and what else is known."""
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        coord.alias("coord"),
        (none("struct<kind:string,horizontal_m:double,vertical_m:double>") if acc is None else acc).alias("accuracy"),
        (none("timestamp") if ts is None else ts).alias("ts"),
        (none("string") if source is None else source).alias("source"),
    )


def confidence(value: Num) -> Column:
    return checked(c(value), c(value).between(0, 1))


def wrap_longitude(lon: Num) -> Column:
    """Longitude in [-180, 180); one that lies there already stays as it is, to the last bit."""

    def wrapped(lon: Column) -> Column:
        x = F.pmod(lon, F.lit(360.0))
        return F.when((lon >= -180.0) & (lon < 180.0), lon).when(x >= 180.0, x - 360.0).otherwise(x) + 0.0

    return let(lon, wrapped) if isinstance(lon, Column) else wrapped(c(lon))


def clamp_latitude(lat: Num) -> Column:
    return F.greatest(F.least(c(lat), F.lit(90.0)), F.lit(-90.0))


def normalize_degrees(deg: Num) -> Column:
    """Degrees in [0, 360); a tiny negative value gives 0, not 360."""
    x = F.pmod(c(deg), F.lit(360.0))
    return F.when(x >= 360.0, F.lit(0.0)).otherwise(x) + 0.0


def hemisphere_sign(h: Column) -> Column:
    return F.when(h.isin("S", "W"), F.lit(-1.0)).otherwise(F.lit(1.0))


def _hemisphere(value: Column, axis: str) -> Column:
    plus, minus = ("N", "S") if axis == "lat" else ("E", "W")
    return F.when(value < 0, minus).otherwise(plus)


def dms_from_degrees(value: Num, axis: str) -> Column:
    """Degrees, whole minutes and unrounded seconds of a signed angle; zero is north or east."""
    value = c(value)
    size = F.abs(value)
    deg = F.floor(size)
    minutes = (size - deg) * 60.0
    whole = F.least(F.floor(minutes), F.lit(59))
    return F.struct(
        deg.cast("int").alias("deg"), whole.cast("int").alias("min"),
        ((minutes - whole) * 60.0).alias("sec"), _hemisphere(value, axis).alias("hemi"),
    )


def dms(deg: Num, minutes: Num, sec: Num, hemi: Column) -> Column:
    top = F.when(hemi.isin("N", "S"), F.lit(90.0)).otherwise(F.lit(180.0))
    ok = (c(minutes) < 60) & (c(minutes) >= 0) & (c(sec) >= 0) & (c(sec) < 60) & (c(deg) >= 0) & (c(deg) + c(minutes) / 60 + c(sec) / 3600 <= top)
    return checked(F.struct(c(deg).cast("int").alias("deg"), c(minutes).cast("int").alias("min"), c(sec).alias("sec"), hemi.alias("hemi")), ok)


def dms_to_degrees(x: Column) -> Column:
    return hemisphere_sign(x["hemi"]) * (x["deg"] + x["min"] / F.lit(60.0) + x["sec"] / F.lit(3600.0))


def dms_to_ddm(x: Column) -> Column:
    return F.struct(x["deg"].alias("deg"), (x["min"] + x["sec"] / 60.0).alias("min"), x["hemi"].alias("hemi"))


def ddm_from_degrees(value: Num, axis: str) -> Column:
    value = c(value)
    deg = F.floor(F.abs(value))
    return F.struct(deg.cast("int").alias("deg"), ((F.abs(value) - deg) * 60.0).alias("min"), _hemisphere(value, axis).alias("hemi"))


def ddm_to_degrees(x: Column) -> Column:
    return hemisphere_sign(x["hemi"]) * (x["deg"] + x["min"] / F.lit(60.0))


def ddm_to_dms(x: Column) -> Column:
    whole = F.floor(x["min"])
    return F.struct(x["deg"].alias("deg"), whole.cast("int").alias("min"), ((x["min"] - whole) * 60.0).alias("sec"), x["hemi"].alias("hemi"))


def crs_name(point: Column) -> Column:
    """Display name of a coordinate's reference system, null for an unknown one."""
    return F.when(point["crs"].isin(*CRS), point["crs"])


def height_length(point: Column) -> Column:
    """The height in metres, whatever surface it is measured from."""
    return point["height_m"]


def approx_map(a: Column, then) -> Column:
    """Another value with the same error bound."""
    return F.struct(then(a["value"]).alias("value"), a["max_error_m"].alias("max_error_m"))


def raw_source(raw: Column, sure: Num) -> Column:
    """Where an observation came from: STRUCT<raw, confidence, axis_order, notes>; null for a confidence outside [0, 1]."""
    source = F.struct(
        raw.alias("raw"), c(sure).alias("confidence"), F.lit(None).cast("string").alias("axis_order"), F.array().cast("array<string>").alias("notes")
    )
    return checked(source, c(sure).between(0, 1))


def ddm(deg: Num, minutes: Num, hemi: Column) -> Column:
    """Degrees and decimal minutes; null for minutes of 60 or more, or past the axis's range."""
    top = F.when(hemi.isin("N", "S"), F.lit(90.0)).otherwise(F.lit(180.0))
    ok = (c(minutes) < 60) & (c(minutes) >= 0) & (c(deg) >= 0) & (c(deg) + c(minutes) / 60 <= top) & hemi.isin("N", "S", "E", "W")
    return checked(F.struct(c(deg).cast("int").alias("deg"), c(minutes).alias("min"), hemi.alias("hemi")), ok)


def datum_point(point: Column, crs: str) -> Column:
    """STRUCT<lat, lon> of a coordinate of that datum, without its height; null where the datum is another."""
    return F.when(point["crs"] == crs, F.struct(point["lat"].alias("lat"), point["lon"].alias("lon")))


def from_datum_point(p: Column, crs: str) -> Column:
    return coordinate(p["lat"], p["lon"], crs)


def finite_struct(ok: Column | None = None, **fields: Column) -> Column:
    """A struct of finite doubles; null where one is not finite, or where ``ok`` is false."""
    good = F.lit(True) if ok is None else ok
    for v in fields.values():
        good = good & finite(v)
    return F.when(good, F.struct(*[(v.cast("double") + 0.0).alias(k) for k, v in fields.items()]))
