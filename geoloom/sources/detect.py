"""One position in a text of any kind that is read: a geo: URI, a Plus Code, an MGRS reference, else free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.codes import geohash_decode, maidenhead_decode, mgrs_decode, plus_code_decode
from geoloom.functions.core import let
from geoloom.sources.freetext import parse_text
from geoloom.sources.sentences import parse_geo_uri

GRIDS = {"plus_code": plus_code_decode, "mgrs": mgrs_decode, "geohash": geohash_decode, "maidenhead": maidenhead_decode}


def _found(how: str, p: Column, bound: Column, sure: Column, error: Column) -> Column:
    return F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), bound.alias("max_error_m"), sure.alias("confidence"), F.lit(how).alias("how"), error.alias("error_kind"))


def _tried(how: str, text: Column, rest: Column) -> Column:
    """``text`` read as a code of one grid, else ``rest``."""
    return let(
        GRIDS[how](text),
        lambda g: F.when(g.isNotNull(), _found(how, g, g["max_error_m"], F.lit(1.0), F.lit(None).cast("string"))).otherwise(rest),
    )


def parse_coordinate(text: Column, expected: str | None = None, default_order: str = "LatLon", decimal_comma: bool = False) -> Column:
    """STRUCT<lat, lon, max_error_m, confidence, how, error_kind, error_detail>.

    ``expected`` names a grid (plus_code, mgrs, geohash or maidenhead) that is tried first; geohashes and locators are only read when
    expected, as plain words can look like them. A text that is nothing else is read as free text; where that fails too, ``error_detail`` says that it is no
    code of the expected grid either. It is null without an error or an expected grid. A null text gives null.
    """
    if expected is not None and expected not in GRIDS:
        raise ValueError(expected)
    nothing = F.lit(None).cast("double")
    free = lambda: let(parse_text(text, default_order, decimal_comma), lambda p: _found("text", p, nothing, p["confidence"], p["error_kind"]))
    uri = lambda: let(parse_geo_uri(text), lambda p: _found("geo_uri", p, p["horizontal_m"], F.when(p["error_kind"].isNull(), 1.0), p["error_kind"]))
    out = F.when(F.lower(F.left(F.trim(text), F.lit(4))) == "geo:", uri()).otherwise(free())
    for how in ["mgrs", "plus_code", *([expected] if expected else [])]:
        out = _tried(how, text, out)
    detail = F.lit(f"not a {expected} reference") if expected else F.lit(None).cast("string")
    out = let(out, lambda p: p.withField("error_detail", F.when(p["error_kind"].isNotNull() & (p["how"] == "text"), detail)))
    return F.when(text.isNotNull(), out)


def options_for(representation: str, separator: str = ".") -> dict[str, object]:
    """Arguments of :func:`parse_coordinate` that read back what is written in a representation."""
    return {"expected": representation} if representation in GRIDS else {"decimal_comma": separator == ","}
