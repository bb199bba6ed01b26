"""Positions in free text, one to a row, as Column expressions.

Read are decimal degrees, degrees with minutes and seconds by signs or letters, and ddmm.m beside a hemisphere letter. A text is
first brought to plain signs, then cut in two, and each half matched by patterns. The result is STRUCT<lat, lon, confidence,
axis_order, error_kind>: ``error_kind`` is Syntax, Ambiguous (no single reading) or OutOfRange (lat and lon are kept), else
null. A null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.core import let

# Typographic signs and the plain ones that they are read as.
TYPOGRAPHY = {"′": "'", "’": "'", "″": '"', "”": '"', "º": "°", "\u00a0": " ", "\u2007": " ", "\u202f": " "}
# How sure the order of axes is by letters on both, by one letter or the range, and by assumption.
BY_LETTERS, BY_ONE, ASSUMED = 1.0, 0.9, 0.7

_LETTER = "(?<![A-Za-z])[NSEWnsew](?![A-Za-z])"
_PLAIN = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_EDGES = r"(?U)^\s+|\s+$"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def plain_signs(text: Column, decimal_comma: bool = False) -> Column:
    """Unicode primes and spaces made plain, commas between digits made points if asked for, unit letters made signs.

    ``s`` ends seconds; ``S`` does so only right before another hemisphere letter, and else is south.
    """
    x = F.translate(_strip(text), "".join(TYPOGRAPHY), "".join(TYPOGRAPHY.values()))
    if decimal_comma:
        x = F.regexp_replace(x, "(?<=[0-9]),(?=[0-9])", ".")
    x = F.regexp_replace(x, r"(?<=[0-9])[dD]([0-9][0-9.]*)[mM]([0-9.]+)(?:s|S(?=[NSEW]))", "°$1'$2\"")
    x = F.regexp_replace(x, r"(?<=[0-9])[dD]([0-9][0-9.]*)[mM]", "°$1'")
    return F.regexp_replace(x, r"(?<=[0-9])[dD](?=[0-9])", "°")


def halves(x: Column, decimal_comma: bool = False) -> Column:
    """The two components as an array: cut at a list sign, else beside hemisphere letters, else at white space; or null."""
    sign = "[,;]" if decimal_comma else ","
    off = sign.replace("[", "[^") if decimal_comma else "[^,]"
    before = rf"(?:(?!{_LETTER}).)*"
    two = F.regexp_count(x, F.lit(_LETTER)) == 2
    ways = [
        (F.lit(True), rf"(?sU)^({off}*?[^\s,{';' if decimal_comma else ''}]{off}*){sign}(.*\S.*)$"),
        (two, rf"(?s)^({before}[0-9°'\".]\s*{_LETTER})(.*)$"),
        (two, rf"(?s)^({before}{_LETTER}{before})({_LETTER}.*)$"),
        (~two, r"(?U)^(\S+)\s+(\S+)$"),
    ]
    out = F.lit(None).cast("array<string>")
    for when, pattern in reversed(ways):
        cut = F.array(*[_strip(F.regexp_extract(x, pattern, k)) for k in (1, 2)])
        out = F.when(when & x.rlike(pattern), cut).otherwise(out)
    return out


def component(half: Column) -> Column:
    """STRUCT<value, axis, error> of one half; the axis (lat or lon) is known by its letter only."""
    last, first = rf"{_LETTER}$", rf"^{_LETTER}"
    letter = F.upper(F.when(half.rlike(last), F.right(half, F.lit(1))).when(half.rlike(first), F.left(half, F.lit(1))))
    body = F.when(half.rlike(last), F.regexp_replace(half, last, "")).otherwise(F.regexp_replace(half, first, ""))
    return let(F.struct(letter.alias("letter"), _strip(body).alias("body")), _signed)


def _signed(c: Column) -> Column:
    fields = F.filter(F.split(F.regexp_replace(c["body"], "^[-+]", ""), r"(?U)[°'\"\s]+"), lambda f: f != "")
    parts = F.struct(c["letter"].alias("letter"), F.startswith(c["body"], F.lit("-")).alias("minus"), fields.alias("f"))
    return let(parts, _value)


def _value(p: Column) -> Column:
    f, n = p["f"], F.size(p["f"])
    some = lambda pattern: F.exists(f, lambda x: x.rlike(pattern))
    number = lambda k: F.coalesce(F.get(F.transform(f, lambda x: F.when(x.rlike(f"^{_PLAIN}$"), x.cast("double"))), k), F.lit(0.0))
    packed = (n == 1) & F.get(f, 0).rlike(r"^[0-9]{4,}")
    whole = F.when(packed, F.floor(number(0) / 100.0).cast("double")).otherwise(number(0))
    minutes = F.when(packed, number(0) - whole * 100.0).otherwise(number(1))
    value = whole + minutes / 60.0 + number(2) / 3600.0
    error = (
        F.when(n == 0, "Syntax")
        .when(some(rf"^{_PLAIN}[eE][+-]?[0-9]+$"), "Ambiguous")
        .when(~F.forall(f, lambda x: x.rlike(f"^{_PLAIN}$")), "Syntax")
        .when(F.exists(F.slice(f, 1, F.greatest(n - 1, F.lit(0))), lambda x: F.contains(x, F.lit("."))), "Ambiguous")
        .when(packed & p["letter"].isNull(), "Ambiguous")
        .when((n > 3) | (minutes >= 60) | (number(2) >= 60), "Syntax")
    )
    error = F.when(p["minus"] & F.coalesce(p["letter"].isin("N", "E"), F.lit(False)), "Syntax").otherwise(error)
    negative = p["minus"] | F.coalesce(p["letter"].isin("S", "W"), F.lit(False))
    axis = F.when(p["letter"].isin("N", "S"), "lat").when(p["letter"].isin("E", "W"), "lon")
    return F.struct(F.when(error.isNull(), F.when(negative, -value).otherwise(value)).alias("value"), axis.alias("axis"), error.alias("error"))


def parse_text(text: Column, default_order: str = "LatLon", decimal_comma: bool = False) -> Column:
    """A position in free text. Axes follow hemisphere letters, else the range of latitudes, else ``default_order``."""
    if default_order not in ("LatLon", "LonLat"):
        raise ValueError(default_order)
    read = lambda h: F.struct(h.isNull().alias("whole"), component(F.get(h, 0)).alias("a"), component(F.get(h, 1)).alias("b"))
    return F.when(text.isNotNull(), let(let(let(plain_signs(text, decimal_comma), lambda x: halves(x, decimal_comma)), read), lambda r: _resolve(r, default_order)))


def _resolve(r: Column, default_order: str) -> Column:
    a, b = r["a"], r["b"]
    far = lambda x: F.abs(x["value"]) > 90
    lettered = a["axis"].isNotNull() | b["axis"].isNotNull()
    turned = (
        F.when(a["axis"].isNotNull(), a["axis"] == "lon")
        .when(b["axis"].isNotNull(), b["axis"] == "lat")
        .when(far(a) != far(b), far(a))
        .otherwise(F.lit(default_order == "LonLat"))
    )
    lat, lon = F.when(turned, b["value"]).otherwise(a["value"]), F.when(turned, a["value"]).otherwise(b["value"])
    sure = F.when(a["axis"].isNotNull() & b["axis"].isNotNull(), BY_LETTERS).when(lettered | (far(a) != far(b)), BY_ONE).otherwise(ASSUMED)
    error = (
        F.when(r["whole"], "Syntax").when(a["error"].isNotNull(), a["error"]).when(b["error"].isNotNull(), b["error"])
        .when(a["axis"] == b["axis"], "Syntax").when(~(lat.between(-90, 90) & lon.between(-180, 180)), "OutOfRange")
    )
    seen, fine = error.isNull() | (error == "OutOfRange"), error.isNull()
    return F.struct(
        F.when(seen, lat + 0.0).alias("lat"), F.when(seen, lon + 0.0).alias("lon"), F.when(fine, sure).alias("confidence"),
        F.when(fine & ~lettered, F.when(turned, "LonLat").otherwise("LatLon")).alias("axis_order"), error.alias("error_kind"),
    )
