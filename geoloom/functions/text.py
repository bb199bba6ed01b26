"""Coordinates as text: decimal degrees, degrees and minutes, and grid codes, as Column expressions.

A magnitude is rounded first and its sign or hemisphere letter follows from the rounded digits, so what rounds to zero is
written without a sign. Numbers are rounded by their shortest decimal form, half up. A null position gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import grids
from geoloom.functions.core import Num, c

# Languages with a decimal comma, and their regions without one.
COMMA_LANGUAGES = "de fr es it ru nl pl pt sv da fi cs tr hu ro nb nn uk bg hr sk sl lt lv ca is et".split()
POINT_REGIONS = {("de", "CH"), ("de", "LI"), ("it", "CH"), ("es", "MX"), ("es", "US"), ("es", "PR")}
# The marks of degrees, minutes and seconds.
SYMBOLS = {"unicode": ("°", "′", "″"), "ascii": ("°", "'", '"'), "letters": ("d", "m", "s")}
# The decimals of the last unit by default and at most, and metres in that unit on a mean sphere.
DECIMALS = {"dd": (6, 15, 111_195.0), "dms": (2, 9, 111_195.0 / 3600.0), "ddm": (3, 12, 111_195.0 / 60.0)}


def separator_for_locale(tag: str) -> str:
    """``,`` or ``.``: the decimal separator usual in a BCP-47 locale; a point where nothing is known."""
    language, *rest = re.split("[-_]", tag)
    region = next((s.upper() for s in rest if re.fullmatch("[A-Za-z]{2}", s)), None)
    return "," if language.lower() in COMMA_LANGUAGES and (language.lower(), region) not in POINT_REGIONS else "."


def _digits(value: Column, places: int | Column, whole: int = 1) -> Column:
    """A size with ``places`` decimals (a number, or a column of 0 to 8) and at least ``whole`` digits before the point."""
    if isinstance(places, Column):
        out = F.when(places.isNull(), F.lit(None).cast("string"))
        for k in range(9):
            out = out.when(places == k, _digits(value, k, whole))
        return out
    return F.when(value.isNotNull(), F.format_string(f"%0{whole + 1 + places if places else whole}.{places}f", value))


def _signed(value: Column, text: Column, letters: str | None, gap: str = "") -> Column:
    minus = (value < 0) & text.rlike("[1-9]")
    if letters is None:
        return F.when(minus, F.concat(F.lit("-"), text)).otherwise(text)
    return F.concat(text, F.lit(gap), F.when(minus, letters[1]).otherwise(letters[0]))


def _places(style: str, decimals: int | Column | None) -> int | Column:
    default, most, _ = DECIMALS[style]
    if isinstance(decimals, int) and not 0 <= decimals <= most:
        raise ValueError(f"decimals must be 0 to {most}")
    return default if decimals is None else decimals


def decimals_for_accuracy(style: str, horizontal_m: Num) -> Column:
    """Decimals that an observation's horizontal accuracy earns, 0 to 8; the style's default where it is null or 0."""
    default, _, unit = DECIMALS[style]
    m = c(horizontal_m)
    earned = F.greatest(F.least(F.round(-F.log10(m / unit)), F.lit(8.0)), F.lit(0.0)).cast("int")
    return F.when(m > 0, earned).otherwise(F.lit(default))


def format_dd(lat: Num, lon: Num, decimals: int | Column | None = None, cardinal: bool = False, separator: str = ".") -> Column:
    """``40.712800, -74.006000``; with a decimal comma a blank parts the two numbers."""
    places = _places("dd", decimals)
    one = lambda v, letters: _signed(c(v), F.replace(_digits(F.abs(c(v)), places), F.lit("."), F.lit(separator)), letters if cardinal else None, " ")
    return F.concat(one(lat, "NS"), F.lit(" " if separator == "," else ", "), one(lon, "EW"))


def _rounded(value: Column, places: int | Column) -> Column:
    """Half away from zero at ``places``, in binary arithmetic."""
    factor = F.pow(F.lit(10.0), places if isinstance(places, Column) else F.lit(float(places)))
    return F.floor(value * factor + 0.5).cast("double") / factor


def _angle(value: Num, style: str, places: int | Column, symbols: str, letters: str | None, separator: str) -> Column:
    value = c(value)
    d, m, s = SYMBOLS[symbols]
    size = F.abs(value)
    deg = F.floor(size)
    minutes = (size - deg) * 60.0
    if style == "dms":
        whole = F.least(F.floor(minutes), F.lit(59))
        sec = _rounded((minutes - whole) * 60.0, places)
        up = (sec >= 60.0).cast("int")
        full = whole + up >= 60
        deg, minute = deg + full.cast("int"), F.when(full, 0).otherwise(whole + up)
        text = F.concat(
            deg.cast("string"), F.lit(d), F.lpad(minute.cast("string"), 2, "0"), F.lit(m),
            F.replace(_digits(F.when(up == 1, sec - 60.0).otherwise(sec), places, 2), F.lit("."), F.lit(separator)), F.lit(s),
        )
    else:
        minute = _rounded(minutes, places)
        up = (minute >= 60.0).cast("int")
        text = F.concat(
            (deg + up).cast("string"), F.lit(d), F.replace(_digits(F.when(up == 1, minute - 60.0).otherwise(minute), places, 2), F.lit("."), F.lit(separator)), F.lit(m)
        )
    return _signed(value, text, letters)


def format_dms(lat: Num, lon: Num, decimals: int | Column | None = None, symbols: str = "unicode", cardinal: bool = True, separator: str = ".") -> Column:
    """``40°42′46.08″N 74°00′21.60″W``; a rounded 60 is carried to the next unit."""
    p = _places("dms", decimals)
    return F.concat(_angle(lat, "dms", p, symbols, "NS" if cardinal else None, separator), F.lit(" "), _angle(lon, "dms", p, symbols, "EW" if cardinal else None, separator))


def format_ddm(lat: Num, lon: Num, decimals: int | Column | None = None, symbols: str = "unicode", cardinal: bool = True, separator: str = ".") -> Column:
    """``40°42.768′N 74°00.360′W``."""
    p = _places("ddm", decimals)
    return F.concat(_angle(lat, "ddm", p, symbols, "NS" if cardinal else None, separator), F.lit(" "), _angle(lon, "ddm", p, symbols, "EW" if cardinal else None, separator))


def format_coordinate(lat: Num, lon: Num, representation: str = "dd", **options) -> Column:
    """One of dd, dms, ddm, geohash(length), plus_code(length), maidenhead(pairs) and mgrs(digits)."""
    makers = {
        "dd": format_dd, "dms": format_dms, "ddm": format_ddm,
        "geohash": grids.geohash, "plus_code": grids.plus_code, "maidenhead": grids.maidenhead, "mgrs": grids.mgrs,
    }
    return makers[representation](lat, lon, **options)


def format_fix(fix: Column, representation: str = "dd", **options) -> Column:
    """An observation as text; decimals that are not set follow its horizontal accuracy."""
    at = fix["coord"]
    if representation in DECIMALS and options.get("decimals") is None:
        options["decimals"] = decimals_for_accuracy(representation, fix["accuracy"]["horizontal_m"])
    return format_coordinate(at["lat"], at["lon"], representation, **options)
