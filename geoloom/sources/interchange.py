"""Positions in GeoJSON, WKT, GPX and KML documents, one document to a row.

Each ``parse_*`` gives STRUCT<positions: ARRAY<STRUCT<lat, lon, height_m, height_kind, horizontal_m, ts>>, error_kind>, in document order;
``error_kind`` is Syntax, TooDeep or OutOfRange and the array then null. A null document gives null. Documents pass through
Arrow in batches; :func:`exploded` makes a row of each position.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.sentences import METERS_PER_HDOP

#: Levels of nesting that are read.
JSON_DEPTH, WKT_DEPTH, KML_DEPTH = 128, 128, 32
SCHEMA = "positions array<struct<lat:double,lon:double,height_m:double,height_kind:string,horizontal_m:double,ts:timestamp>>, error_kind string"
_GEOMETRIES = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


class Fault(ValueError):
    """A document that cannot be read; its argument is the kind."""


def _position(lon: float, lat: float, height: float | None = None, surface: str = "ellipsoidal", horizontal: float | None = None, ts: datetime | None = None) -> dict:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise Fault("OutOfRange")
    return {"lat": lat + 0.0, "lon": lon + 0.0, "height_m": height, "height_kind": None if height is None else surface, "horizontal_m": horizontal, "ts": ts}


def _geojson(text: str) -> Iterator[dict]:
    depth = 0
    for mark in re.findall(r'"(?:\\.|[^"\\])*"|[\[\]{}]', text):
        depth += (mark in "[{") - (mark in "]}")
        if depth > JSON_DEPTH:
            raise Fault("TooDeep")
    todo = [json.loads(text)]
    while todo:
        node = todo.pop()
        kind = node["type"]
        if kind == "FeatureCollection":
            todo += reversed(node["features"])
        elif kind == "Feature":
            todo += [node["geometry"]] if node["geometry"] is not None else []
        elif kind == "GeometryCollection":
            todo += reversed(node["geometries"])
        else:
            points = [node["coordinates"]]
            for _ in range(_GEOMETRIES[kind]):
                points = [p for part in points for p in part]
            for p in points:
                if len(p) < 2 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in p):
                    raise Fault("Syntax")
                yield _position(float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else None)


_WKT = re.compile(r"\s*([A-Za-z]+|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[(),])")
#: How many brackets lie around a position, by kind; the points of a multipoint may have a pair of their own.
_NESTED = {"POINT": 1, "LINESTRING": 1, "MULTIPOINT": 1, "POLYGON": 2, "MULTILINESTRING": 2, "MULTIPOLYGON": 3}


def _wkt(text: str, lon_first: bool) -> Iterator[dict]:
    marks, at = [], 0
    text = text.strip()
    while at < len(text):
        if not (m := _WKT.match(text, at)):
            raise Fault("Syntax")
        marks.append(m[1])
        at = m.end()
    depth = 0
    for m in marks:
        depth += (m == "(") - (m == ")")
        if depth > WKT_DEPTH:
            raise Fault("TooDeep")
    marks.append("")
    out: list[dict] = []

    def need(k: int, mark: str) -> int:
        if marks[k] != mark:
            raise Fault("Syntax")
        return k + 1

    def several(k: int, one: Callable[[int], int]) -> int:
        k = one(need(k, "("))
        while marks[k] == ",":
            k = one(k + 1)
        return need(k, ")")

    def position(k: int, size: int | None, measured: bool) -> int:
        numbers = []
        while marks[k] and marks[k][0] in "+-.0123456789":
            numbers.append(float(marks[k]))
            k += 1
        if not 2 <= len(numbers) <= 4 or (size and len(numbers) != size):
            raise Fault("Syntax")
        x, y = numbers[:2]
        out.append(_position(*((x, y) if lon_first else (y, x)), None if len(numbers) == 2 or measured else numbers[2]))
        return k

    def geometry(k: int) -> int:
        kind = marks[k].upper()
        k += 1
        extra = marks[k].upper() if marks[k].upper() in ("Z", "M", "ZM") else ""
        k += bool(extra)
        if marks[k].upper() == "EMPTY":
            return k + 1
        if kind == "GEOMETRYCOLLECTION":
            return several(k, geometry)
        if kind not in _NESTED:
            raise Fault("Syntax")
        size = 2 + len(extra) if extra else None
        point = lambda k: position(k, size, extra == "M")
        if kind == "POINT":
            return need(point(need(k, "(")), ")")
        if kind == "MULTIPOINT":
            return several(k, lambda k: need(point(k + 1), ")") if marks[k] == "(" else k + 1 if marks[k].upper() == "EMPTY" else point(k))
        one = point
        for _ in range(_NESTED[kind] - 1):
            one = lambda k, inner=one: several(k, inner)
        return several(k, one)

    if geometry(0) != len(marks) - 1:
        raise Fault("Syntax")
    yield from out


def _tree(text: str, root: str) -> ElementTree.Element:
    if "<!DOCTYPE" in text:
        raise Fault("Syntax")
    tree = ElementTree.fromstring(text)
    for node in tree.iter():
        node.tag = node.tag.rpartition("}")[2]
    if tree.tag != root:
        raise Fault("Syntax")
    return tree


def _gpx(text: str) -> Iterator[dict]:
    tree = _tree(text, "gpx")
    number = lambda node, name: float(node.findtext(name)) if node.find(name) is not None else None
    for path in ("wpt", "trk/trkseg/trkpt", "rte/rtept"):
        for node in tree.findall(path):
            time, hdop = node.findtext("time"), number(node, "hdop")
            ts = None if time is None else datetime.fromisoformat(time.strip().replace("Z", "+00:00"))
            ts = ts.replace(tzinfo=timezone.utc) if ts is not None and ts.tzinfo is None else ts
            if hdop is not None and hdop < 0:
                raise Fault("Syntax")
            yield _position(float(node.attrib["lon"]), float(node.attrib["lat"]), number(node, "ele"), "orthometric", None if hdop is None else hdop * METERS_PER_HDOP, ts)


def _kml(text: str) -> Iterator[dict]:
    todo = [(_tree(text, "kml"), 1)]
    while todo:
        node, depth = todo.pop()
        if depth > KML_DEPTH:
            raise Fault("TooDeep")
        if node.tag in ("Point", "LineString", "LinearRing"):
            found = (node.findtext("coordinates") or "").split()
            if node.tag == "Point" and len(found) != 1:
                raise Fault("Syntax")
            for part in found:
                numbers = [float(x) for x in part.split(",")]
                if not 2 <= len(numbers) <= 3:
                    raise Fault("Syntax")
                yield _position(*numbers, "orthometric") if len(numbers) == 3 else _position(*numbers)
        else:
            # A polygon's outer ring comes before its inner ones.
            below = sorted(node, key=lambda x: x.tag == "innerBoundaryIs") if node.tag == "Polygon" else list(node)
            todo += [(x, depth + 1) for x in reversed(below)]


def _read(text: Column, walk: Callable[[str], Iterator[dict]]) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        found, errors = [], []
        for t in texts:
            positions, error = None, None
            if t is not None:
                try:
                    positions = list(walk(t))
                except Fault as e:
                    error = e.args[0]
                except RecursionError:
                    error = "TooDeep"
                except (ValueError, KeyError, TypeError, AttributeError, ElementTree.ParseError):
                    error = "Syntax"
            found.append(positions)
            errors.append(error)
        return pd.DataFrame({"positions": pd.Series(found, dtype=object), "error_kind": pd.Series(errors, dtype=object)})

    return F.when(text.isNotNull(), run(text))


def parse_geojson(text: Column) -> Column:
    """Geometries, features and collections; a third number is an ellipsoidal height, a null geometry has no positions."""
    return _read(text, _geojson)


def parse_wkt(text: Column, axis_order: str = "LonLat") -> Column:
    """Well-known text with the caller's axis order; Z is read as ellipsoidal height, M left out."""
    if axis_order not in ("LonLat", "LatLon"):
        raise ValueError(axis_order)
    return _read(text, lambda t: _wkt(t, axis_order == "LonLat"))


def parse_gpx(text: Column) -> Column:
    """Waypoints, then track points, then route points; elevations are orthometric, HDOP gives a one-sigma error."""
    return _read(text, _gpx)


def parse_kml(text: Column) -> Column:
    """Placemark geometries; altitudes are orthometric. Unbalanced markup and points without a position are Syntax."""
    return _read(text, _kml)


READERS = {"geojson": parse_geojson, "wkt": parse_wkt, "gpx": parse_gpx, "kml": parse_kml}


def exploded(docs: DataFrame, parsed: str) -> DataFrame:
    """One row for each position of the documents in column ``parsed``: the other columns, nth (from 0) and the position's fields."""
    others = [c for c in docs.columns if c != parsed]
    return docs.select(*others, F.posexplode(F.col(parsed)["positions"]).alias("nth", "position")).select(*others, "nth", "position.*")


def read_documents(spark, path: str, kind: str) -> DataFrame:
    """Positions of whole files of one kind: file, error_kind, nth and the position's fields. A file that cannot be read, or has no
    position, gives one row with its error_kind (null if it just has none) and nulls."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), READERS[kind](F.col("value")).alias("parsed"))
    found = files.select("file", "parsed.error_kind", F.posexplode_outer("parsed.positions").alias("nth", "position"))
    return found.select("file", "error_kind", "nth", "position.*")
