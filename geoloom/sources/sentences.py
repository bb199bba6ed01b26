"""NMEA 0183 sentences and geo: URIs, one to a row, as Column expressions for batch and streaming text sources.

Both give STRUCT<lat, lon, height_m, height_kind, horizontal_m, accuracy_kind, ts, notes, error_kind>. Where a text cannot be read,
``error_kind`` names why (Syntax, Checksum, Unsupported, NoFix, OutOfRange) and the other fields are null, but that a
position off the globe keeps its lat and lon. A null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import let

# Fixed value: metres of one-sigma error for one unit of dilution.
METERS_PER_HDOP = 5.0
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_HEX = "0123456789ABCDEF"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _result(
    error: Column, lat: Column, lon: Column, height: Column, height_kind: str, horizontal: Column, accuracy_kind: str, ts: Column, notes: Column
) -> Column:
    read = F.struct(
        error.alias("error"), lat.alias("lat"), lon.alias("lon"), height.alias("height"), horizontal.alias("horizontal"), ts.alias("ts"), notes.alias("notes")
    )

    def judged(r: Column) -> Column:
        off = r["error"].isNull() & ~(r["lat"].between(-90, 90) & r["lon"].between(-180, 180))
        return let(F.when(off, "OutOfRange").otherwise(r["error"]), lambda error: shown(r, error))

    def shown(r: Column, error: Column) -> Column:
        fine = lambda x: F.when(error.isNull(), x)
        seen = lambda x: F.when(error.isNull() | (error == "OutOfRange"), x + 0.0)
        return F.struct(
            seen(r["lat"]).alias("lat"), seen(r["lon"]).alias("lon"), fine(r["height"]).alias("height_m"),
            fine(F.when(r["height"].isNotNull(), height_kind)).alias("height_kind"), fine(r["horizontal"]).alias("horizontal_m"),
            fine(F.when(r["horizontal"].isNotNull(), accuracy_kind)).alias("accuracy_kind"), fine(r["ts"]).alias("ts"),
            fine(r["notes"]).alias("notes"), error.alias("error_kind"),
        )

    return let(read, judged)


def _checksum(data: Column) -> Column:
    """Exclusive or of the bytes, as two upper-case digits of base 16."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda k: F.conv(F.hex(F.substring(F.encode(data, "UTF-8"), k, F.lit(1))), 16, 10).cast("int"))
    x = F.when(F.octet_length(data) == 0, F.lit(0)).otherwise(F.aggregate(codes, F.lit(0), lambda a, b: a.bitwiseXOR(b)))
    digit = lambda v: F.substring(F.lit(_HEX), v + 1, F.lit(1))
    return let(x, lambda v: F.concat(digit(F.shiftright(v, 4)), digit(v.bitwiseAND(15))))


def _axis(value: Column, letter: Column, digits: int, letters: str) -> Column:
    """Degrees of a ddmm.m or dddmm.m field and its letter; null where either is malformed."""
    whole, minutes = F.substring(value, 1, digits).cast("double"), F.substr(value, F.lit(digits + 1)).cast("double")
    ok = value.rlike(rf"^[0-9]{{{digits}}}[0-5][0-9](\.[0-9]*)?$") & F.upper(letter).isin(*letters)
    size = whole + minutes / 60.0
    return F.when(ok, F.when(F.upper(letter) == letters[1], -size).otherwise(size))


def _number(value: Column) -> Column:
    return F.when(value.rlike(_NUMBER), value.cast("double"))


def _rmc_time(time: Column, date: Column) -> Column:
    """UTC instant of hhmmss[.f] and ddmmyy within 1980 to 2079; a leap second falls on the next; else null."""
    two = lambda s, at: F.substring(s, at, 2).cast("int")
    year = F.when(two(date, 5) >= 80, two(date, 5) + 1900).otherwise(two(date, 5) + 2000)
    ok = time.rlike(r"^([01][0-9]|2[0-3])[0-5][0-9]([0-5][0-9]|60)(\.[0-9]*)?$") & date.rlike("^[0-9]{6}$")
    day = F.try_to_date(F.concat(year.cast("string"), F.lit("-"), F.substring(date, 3, 2), F.lit("-"), F.substring(date, 1, 2)), "yyyy-MM-dd")
    micros = F.rpad(F.substring(F.regexp_extract(time, r"\.([0-9]*)$", 1), 1, 6), 6, "0").cast("bigint")
    seconds = F.unix_date(day).cast("bigint") * 86400 + two(time, 1) * 3600 + two(time, 3) * 60 + two(time, 5)
    return F.when(ok & day.isNotNull(), F.timestamp_micros(seconds * 1000000 + micros))


def parse_nmea(sentence: Column) -> Column:
    """A GGA, RMC or GLL sentence with any talker; the checksum is checked where there is one.

    Void status, mode N and quality 0 are NoFix. Heights are orthometric; HDOP gives a one-sigma error. A date that
    cannot be read leaves ``ts`` null and a note.
    """
    data = lambda body: F.substring_index(body, "*", 1)
    sign = lambda body: F.when(F.contains(body, F.lit("*")), F.trim(F.substr(body, F.length(data(body)) + 2)))
    parts = lambda body: F.struct(data(body).alias("data"), sign(body).alias("sign"), F.split(data(body), ",").alias("f"))
    return F.when(sentence.isNotNull(), let(let(F.regexp_replace(F.trim(sentence), r"^\$", ""), parts), _nmea))


def _nmea(s: Column) -> Column:
    """What each step reads is worked out once by the step before; written out in each other the steps multiply."""

    def texts(f: Column) -> Column:
        at = lambda k: F.trim(F.coalesce(F.get(s["f"], k), F.lit("")))
        field = lambda gga, rmc, gll: F.when(f == "GGA", at(gga)).when(f == "RMC", at(rmc)).otherwise(at(gll))
        axes = {"lat": field(2, 3, 1), "lat_letter": field(3, 4, 2), "lon": field(4, 5, 3), "lon_letter": field(5, 6, 4)}
        return F.struct(f.alias("kind"), *[x.alias(k) for k, x in axes.items()], *[at(k).alias(f"at{k}") for k in (1, 2, 6, 7, 8, 9, 10, 11, 12)])

    def values(t: Column) -> Column:
        dated = (t["kind"] == "RMC") & (t["at1"] != "") & (t["at9"] != "")
        numbers = [_number(t[f"at{k}"]).alias(f"n{k}") for k in (8, 9, 11)]
        return F.struct(
            t.alias("t"), _axis(t["lat"], t["lat_letter"], 2, "NS").alias("lat"), _axis(t["lon"], t["lon_letter"], 3, "EW").alias("lon"), *numbers,
            dated.alias("dated"), F.when(dated, _rmc_time(t["at1"], t["at9"])).alias("ts"),
        )

    def read(v: Column) -> Column:
        t, lat, lon = v["t"], v["lat"], v["lon"]
        gga, at = t["kind"] == "GGA", lambda k: t[f"at{k}"]
        malformed = lambda k: (at(k) != "") & v[f"n{k}"].isNull()
        bad_gga = (
            malformed(9) | malformed(11) | malformed(8) | ((at(9) != "") & (at(10) != "M")) | ((at(11) != "") & (at(12) != "M")) | F.coalesce(v["n8"] < 0, F.lit(False))
        )
        no_fix = F.when(gga, at(6) == "0").when(t["kind"] == "RMC", (at(2) == "V") | (at(12) == "N")).otherwise((at(6) == "V") | (at(7) == "N"))
        error = (
            F.when(s["sign"].isNotNull() & (~s["sign"].rlike("^[0-9A-Fa-f]{2}$") | (F.upper(s["sign"]) != _checksum(s["data"]))), "Checksum")
            .when(~t["kind"].isin("GGA", "RMC", "GLL"), "Unsupported")
            .when(no_fix, "NoFix")
            .when(lat.isNull() | lon.isNull(), "Syntax")
            .when(lat.between(-90, 90) & lon.between(-180, 180) & gga & F.coalesce(bad_gga, F.lit(True)), "Syntax")
        )
        note = F.concat(F.lit("RMC date '"), at(9), F.lit("' / time '"), at(1), F.lit("' unreadable; timestamp left empty"))
        notes = F.when(v["dated"] & v["ts"].isNull(), F.array(note)).otherwise(F.array().cast("array<string>"))
        return _result(error, lat, lon, F.when(gga, v["n9"]), "orthometric", F.when(gga, v["n8"] * METERS_PER_HDOP), "OneSigma", v["ts"], notes)

    return let(let(let(F.right(F.get(s["f"], 0), F.lit(3)), texts), values), read)


def parse_geo_uri(uri: Column) -> Column:
    """An RFC 5870 geo: URI: lat,lon[,alt][;crs=wgs84][;u=metres][;other parameters, which are noted]."""
    rest = F.substr(F.trim(uri), F.lit(5))
    pieces = F.split(rest, ";", -1)
    numbers = F.transform(F.split(F.get(pieces, 0), ",", -1), lambda x: F.trim(x))
    params = F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("key"), F.trim(F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).alias("value"), F.trim(p).alias("all")),
    )
    parts = F.struct((F.lower(F.substring(F.trim(uri), 1, 4)) == "geo:").alias("geo"), numbers.alias("n"), params.alias("p"))
    return F.when(uri.isNotNull(), let(parts, _geo_uri))


def _geo_uri(s: Column) -> Column:
    number = lambda k: _number(F.get(s["n"], k))
    keys = F.transform(s["p"], lambda p: p["key"])
    times = lambda key: F.size(F.filter(keys, lambda k: k == key))
    crs = F.get(F.filter(s["p"], lambda p: p["key"] == "crs"), 0)["value"]
    u = _number(F.get(F.filter(s["p"], lambda p: p["key"] == "u"), 0)["value"])
    # The first fault in reading order decides: a wrong crs is met before what follows it.
    before = F.slice(s["p"], 1, F.greatest(F.array_position(keys, "crs").cast("int") - 1, F.lit(0)))
    empty = lambda ps: F.exists(ps, lambda p: p["all"] == "")
    early = empty(before) | F.exists(before, lambda p: p["key"] == "u")
    error = (
        F.when(~s["geo"] | number(0).isNull() | number(1).isNull() | ~F.size(s["n"]).between(2, 3) | ((F.size(s["n"]) == 3) & number(2).isNull()), "Syntax")
        .when((times("crs") > 0) & early, "Syntax")
        .when((times("crs") > 0) & (F.lower(crs) != "wgs84"), "Unsupported")
        .when(empty(s["p"]) | (times("crs") > 1) | (times("u") > 1) | ((times("u") == 1) & F.coalesce(u < 0, F.lit(True))), "Syntax")
    )
    unknown = F.filter(s["p"], lambda p: ~p["key"].isin("crs", "u"))
    notes = F.transform(unknown, lambda p: F.concat(F.lit("ignored unknown parameter '"), F.substring_index(p["all"], "=", 1), F.lit("'")))
    return _result(error, number(0), number(1), number(2), "ellipsoidal", u, "Unspecified", _none("timestamp"), notes)
