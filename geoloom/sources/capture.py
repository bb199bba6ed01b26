"""GPS tags of photos (EXIF values and XMP strings) as Column expressions.

The tag struct has latitude and longitude (three rationals STRUCT<num, den> for EXIF, one string for XMP), their refs, altitude,
altitude_ref, map_datum, h_positioning_error, dop, date_stamp, time_stamp, img_direction, speed and track with refs; fields that are
absent count as null. The result is STRUCT<lat, lon, crs, height_m, height_kind, horizontal_m, dop, ts, direction, speed_mps, track,
confidence, possibly_gcj02, notes, error_kind>; where there is no position, ``error_kind`` says why (NoFix, Syntax, OutOfRange).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.functions.china import in_china_box
from geoloom.functions.core import BD09, GCJ02, METERS_PER_UNIT, TOKYO, WGS84, let

# Names of datums as written in tags, letters and digits only; confidence in a datum that is assumed; units of speed.
DATUMS = {"WGS84": WGS84, "WGS1984": WGS84, "WORLDGEODETICSYSTEM1984": WGS84, "EPSG4326": WGS84, "TOKYO": TOKYO, "GCJ02": GCJ02, "BD09": BD09}
ASSUMED = 0.7
SPEEDS = {"K": "km", "M": "mi", "N": "nmi"}
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"


def north_bearing(degrees: Column, reference: Column) -> Column:
    """STRUCT<degrees, reference> with degrees in [0, 360) and reference T (true), M (magnetic) or null; else null."""

    def bearing(v: Column) -> Column:
        ok = (v["degrees"] >= 0) & (v["degrees"] < 360) & (v["reference"].isNull() | v["reference"].isin("T", "M"))
        return F.when(ok, F.struct((v["degrees"] + 0.0).alias("degrees"), v["reference"].alias("reference")))

    return let(F.struct(degrees.alias("degrees"), F.upper(_clean(reference)).alias("reference")), bearing)


def _clean(x: Column) -> Column:
    """Without blanks and NULs around; null if nothing is left."""
    return F.nullif(F.regexp_replace(x, r"(?U)^[\s\x00]+|[\s\x00]+$", ""), F.lit(""))


def _rational(x: Column) -> Column:
    """Value of a rational; null for a zero denominator."""
    return F.when(x["den"] != 0, x["num"].cast("double") / x["den"].cast("double"))


def _number(x: Column) -> Column:
    """Value of a decimal or of a quotient such as 25/10; null for another text."""
    whole = F.regexp_extract(x, r"^\s*([0-9]+)\s*/\s*([0-9]+)\s*$", 1)
    below = F.regexp_extract(x, r"^\s*([0-9]+)\s*/\s*([0-9]+)\s*$", 2)
    return F.when(x.rlike(_DECIMAL), F.trim(x).try_cast("double")).when((whole != "") & (below.try_cast("double") != 0), whole.try_cast("double") / below.try_cast("double"))


def instant(date: Column, time: Column, offset_minutes: Column | int = 0) -> Column:
    """UTC timestamp of a date yyyy:mm:dd (or with hyphens) and an array of hours, minutes and seconds, to the microsecond; null if
    either cannot be read."""
    offset = offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)
    day = lambda d: F.when(d.rlike("^[0-9]{4}[:-][0-9]{2}[:-][0-9]{2}$"), F.try_to_date(F.translate(d, ":", "-"), "yyyy-MM-dd"))

    def at(v: Column) -> Column:
        h, m, s = (F.get(v["time"], k) for k in range(3))
        ok = (h >= 0) & (h < 24) & (m >= 0) & (m < 60) & (s >= 0) & (s < 61)
        micros = F.round((h * 3600.0 + m * 60.0 + s) * 1e6).cast("bigint") - offset.cast("bigint") * 60_000_000
        return F.when(ok & v["day"].isNotNull(), F.timestamp_micros(F.unix_date(v["day"]).cast("bigint") * 86_400_000_000 + micros))

    return let(F.struct(let(_clean(date), day).alias("day"), time.alias("time")), at)


def _signed(parts: Column, ref: Column, letters: str) -> Column:
    """Degrees of three parts and a letter; null for minutes or seconds of 60 or more, or another letter."""
    def signed(v: Column) -> Column:
        parts, letter = v["parts"], v["letter"]
        size = F.get(parts, 0) + F.get(parts, 1) / 60.0 + F.get(parts, 2) / 3600.0
        return F.when((F.get(parts, 1) < 60) & (F.get(parts, 2) < 60) & letter.isin(*letters), F.when(letter == letters[1], -size).otherwise(size))

    return let(F.struct(parts.alias("parts"), F.upper(_clean(ref)).alias("letter")), signed)


def capture(
    lat_parts: Column, lat_ref: Column, lon_parts: Column, lon_ref: Column, tags: dict[str, Column], none: Column, strict: bool = False, reject_null_island: bool = False
) -> Column:
    """The rules that EXIF and XMP share. tags: the other values, numbers as doubles; none: there is no position at all.

    An auxiliary tag whose value or ref is wrong is dropped with a note, or with ``strict`` makes the whole record an error.
    """
    lat, lon = _signed(lat_parts, lat_ref, "NS"), _signed(lon_parts, lon_ref, "EW")
    name = F.upper(F.regexp_replace(tags["map_datum"], "[^A-Za-z0-9]", ""))
    crs = F.element_at(F.create_map(*[F.lit(x) for pair in DATUMS.items() for x in pair]), name)

    def judge(v: Column) -> Column:
        altitude, surface = tags["altitude"], F.coalesce(tags["altitude_ref"], F.lit(0))
        height = F.when(surface.isin(1, 3), F.lit(0.0) - altitude).otherwise(altitude)
        unit = F.upper(_clean(tags["speed_ref"]))
        factor = F.element_at(F.create_map(*[x for k, u in SPEEDS.items() for x in (F.lit(k), F.lit(METERS_PER_UNIT[u] / 3600.0))]), unit)
        aimed = lambda k: north_bearing(tags[k], tags[f"{k}_ref"])
        faults = {
            "GPSAltitude/GPSAltitudeRef": ~surface.between(0, 3) | tags["altitude_bad"],
            "GPSHPositioningError": tags["h_positioning_error_bad"] | (tags["h_positioning_error"] < 0),
            "GPSDOP": tags["dop_bad"], "GPSTimeStamp": tags["time_bad"],
            "GPSSpeed/GPSSpeedRef": tags["speed_bad"] | (unit.isNotNull() & factor.isNull()),
            "GPSImgDirection/GPSImgDirectionRef": tags["img_direction_bad"] | (tags["img_direction"].isNotNull() & aimed("img_direction").isNull()),
            "GPSTrack/GPSTrackRef": tags["track_bad"] | (tags["track"].isNotNull() & aimed("track").isNull()),
        }
        faults = {k: F.coalesce(x, F.lit(False)) for k, x in faults.items()}
        assumed = v["crs"].isNull()
        notes = [
            F.when(assumed & v["name"].isNotNull(), F.concat(F.lit("GPSMapDatum not recognised: "), _clean(tags["map_datum"]), F.lit("; assumed WGS-84"))),
            F.when(assumed & v["name"].isNull(), F.lit("GPSMapDatum absent; assumed WGS-84")),
            F.when(_clean(tags["date"]).isNotNull() & tags["time"].isNotNull() & tags["ts"].isNull() & ~faults["GPSTimeStamp"], F.lit("date unreadable; no timestamp")),
            F.when(tags["speed"].isNotNull() & unit.isNull(), F.lit("GPSSpeed has no GPSSpeedRef, so its unit is unknown; dropped")),
            *[F.when(x, F.lit(f"{k} invalid, dropped")) for k, x in faults.items()],
        ]
        bad = F.lit(False)
        for x in faults.values():
            bad = bad | x
        error = (
            F.when(none, "NoFix").when(v["lat"].isNull() | v["lon"].isNull(), "Syntax").when(~(v["lat"].between(-90, 90) & v["lon"].between(-180, 180)), "OutOfRange")
            .when(F.lit(reject_null_island) & (v["lat"] == 0) & (v["lon"] == 0), "NoFix").when(F.lit(strict) & bad, "Syntax")
        )
        # Each of these is asked for many times below.
        drops = F.struct(*[x.alias(f"f{k}") for k, x in enumerate(faults.values())])
        judged = F.struct(error.alias("error"), drops.alias("drops"), height.alias("height"), surface.alias("surface"), (tags["speed"] * factor).alias("speed"), F.array_compact(F.array(*notes)).alias("notes"))
        return let(judged, lambda j: build(v, j, dict(zip(faults, [j["drops"][f"f{k}"] for k in range(len(faults))]))))

    def build(v: Column, j: Column, faults: dict[str, Column]) -> Column:
        aimed = lambda k: north_bearing(tags[k], tags[f"{k}_ref"])
        fine = lambda key, x: F.when(~faults[key], x)
        ok = lambda x: F.when(v["known"] & j["error"].isNull(), x)
        kept, surface, assumed = fine("GPSAltitude/GPSAltitudeRef", j["height"]), j["surface"], v["crs"].isNull()
        return F.struct(
            ok(v["lat"] + 0.0).alias("lat"), ok(v["lon"] + 0.0).alias("lon"), ok(F.coalesce(v["crs"], F.lit(WGS84))).alias("crs"), ok(kept).alias("height_m"),
            ok(F.when(kept.isNotNull(), F.when(surface >= 2, "ellipsoidal").otherwise("orthometric"))).alias("height_kind"),
            ok(fine("GPSHPositioningError", tags["h_positioning_error"])).alias("horizontal_m"), ok(fine("GPSDOP", tags["dop"])).alias("dop"), ok(tags["ts"]).alias("ts"),
            ok(fine("GPSImgDirection/GPSImgDirectionRef", aimed("img_direction"))).alias("direction"), ok(fine("GPSSpeed/GPSSpeedRef", j["speed"])).alias("speed_mps"),
            ok(fine("GPSTrack/GPSTrackRef", aimed("track"))).alias("track"), ok(F.when(assumed, ASSUMED).otherwise(1.0)).alias("confidence"),
            ok(assumed & in_china_box(v["lat"], v["lon"])).alias("possibly_gcj02"), ok(j["notes"]).alias("notes"), F.when(v["known"], j["error"]).alias("error_kind"),
        )

    return let(F.struct(lat.alias("lat"), lon.alias("lon"), name.alias("name"), crs.alias("crs"), F.lit(True).alias("known")), judge)


def _once(lat: tuple[Column, Column], lon: tuple[Column, Column], tags: dict[str, Column], none: Column, strict: bool, reject_null_island: bool) -> Column:
    """:func:`capture` of tags that are worked out once, however often its rules ask for them."""
    own = {"lat_parts": lat[0], "lat_ref": lat[1], "lon_parts": lon[0], "lon_ref": lon[1], "none": none}
    made = F.struct(*[x.alias(k) for k, x in (own | tags).items()])
    return let(made, lambda t: capture(t["lat_parts"], t["lat_ref"], t["lon_parts"], t["lon_ref"], {k: t[k] for k in tags}, t["none"], strict, reject_null_island))


def _field(gps: Column, schema: StructType, kind: str):
    names = set(schema.names)
    return lambda name, of=kind: gps[name] if name in names else F.lit(None).cast(of)


def from_exif(gps: Column, schema: StructType, strict: bool = False, reject_null_island: bool = False) -> Column:
    """A capture record from EXIF tag values; a position of six times 0/0 is none. schema: the tag struct's type."""
    get = _field(gps, schema, "string")
    axis = lambda name: F.transform(get(name, "array<struct<num:bigint,den:bigint>>"), _rational)
    zeros = lambda name: F.forall(get(name), lambda r: (r["num"] == 0) & (r["den"] == 0))
    tags: dict[str, Column] = {k: get(k) for k in ("map_datum", "speed_ref", "img_direction_ref", "track_ref")}
    tags |= {"altitude_ref": get("altitude_ref", "int"), "date": get("date_stamp"), "time": axis("time_stamp")}
    for k in ("altitude", "h_positioning_error", "dop", "img_direction", "speed", "track"):
        raw = get(k, "struct<num:bigint,den:bigint>")
        tags |= {k: _rational(raw), f"{k}_bad": raw.isNotNull() & _rational(raw).isNull()}
    time = tags["time"]
    tags["time_bad"] = time.isNotNull() & F.exists(time, lambda x: x.isNull())
    tags["ts"] = instant(tags["date"], time)
    none = get("latitude").isNull() | get("longitude").isNull() | (zeros("latitude") & zeros("longitude"))
    made = _once((axis("latitude"), get("latitude_ref")), (axis("longitude"), get("longitude_ref")), tags, F.coalesce(none, F.lit(True)), strict, reject_null_island)
    return F.when(gps.isNotNull(), made)


def from_xmp(gps: Column, schema: StructType, strict: bool = False, reject_null_island: bool = False) -> Column:
    """A capture record from XMP strings: positions as ``d,m.mN`` or ``d,m,sN``, an ISO time stamp, other numbers as text."""
    names = ("latitude", "longitude", "map_datum", "speed_ref", "img_direction_ref", "track_ref", "altitude_ref", "altitude", "h_positioning_error", "dop", "img_direction", "speed", "track", "time_stamp")
    get = _field(gps, schema, "string")
    cleaned = F.struct(*[(get(k) if k == "map_datum" or k.endswith("_ref") and k != "altitude_ref" else _clean(get(k))).alias(k) for k in names])
    return F.when(gps.isNotNull(), let(cleaned, lambda t: _from_strings(t, strict, reject_null_island)))


def _from_strings(got: Column, strict: bool, reject_null_island: bool) -> Column:
    """got: the XMP strings without blanks around, but the datum and the letters as they are."""
    get = lambda name: got[name]

    def axis(name: str) -> tuple[Column, Column]:
        text = get(name)
        numbers = F.transform(F.split(F.left(text, F.length(text) - 1), ","), lambda x: F.when(x.rlike(_DECIMAL), F.trim(x).try_cast("double")))
        three = let(numbers, lambda n: F.when(F.size(n) == 2, F.concat(n, F.array(F.lit(0.0)))).when(F.size(n) == 3, n))
        return three, F.right(text, F.lit(1))

    tags: dict[str, Column] = {k: get(k) for k in ("map_datum", "speed_ref", "img_direction_ref", "track_ref")}
    ref = get("altitude_ref")
    tags["altitude_ref"] = F.when(ref.isNotNull(), F.coalesce(ref.try_cast("int"), F.lit(-1)))
    for k in ("altitude", "h_positioning_error", "dop", "img_direction", "speed", "track"):
        raw = get(k)
        tags |= {k: _number(raw), f"{k}_bad": raw.isNotNull() & _number(raw).isNull()}
    stamp = get("time_stamp")
    pattern = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]*)?))?(Z|([+-])([0-9]{2}):([0-9]{2}))?$"
    part = lambda k: F.regexp_extract(stamp, pattern, k)
    zero = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).try_cast("double"), F.lit(0.0))
    offset = (zero(7) * 60 + zero(8)) * F.when(part(6) == "-", -1).otherwise(1)
    tags["date"], tags["time"] = part(1), F.when(stamp.rlike(pattern), F.array(zero(2), zero(3), zero(4)))
    tags["time_bad"] = stamp.isNotNull() & ~stamp.rlike(pattern)
    tags["ts"] = instant(tags["date"], tags["time"], offset)
    none = get("latitude").isNull() | get("longitude").isNull()
    return _once(axis("latitude"), axis("longitude"), tags, none, strict, reject_null_island)
