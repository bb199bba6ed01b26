"""Gazetteer files: a checksummed header, a pool of strings, tables of divisions, then places, all little-endian with varints.

A file is at most 4 GiB and is read by one task, as its varints have no index; many files are read by many tasks. Places are
written in files of a fixed number of places.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from geoloom.operators.gazetteer import is_language_tag

# Fixed values of the format: magic, version, header (magic, version, flags, payload bytes, CRC-32 of the payload), classes.
MAGIC, VERSION, HEADER, CLASSES = b"GCGZ", 1, "<4sHHII", 7

_PLACE = pa.schema(
    [
        ("idx", pa.int64()), ("name", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("country", pa.string()), ("class", pa.int32()), ("population", pa.int64()),
        ("admin1_code", pa.string()), ("admin1_name", pa.string()), ("admin2_code", pa.string()), ("admin2_name", pa.string()), ("localized", pa.map_(pa.string(), pa.string())),
        ("source_date", pa.string()), ("attribution", pa.string()), ("file", pa.string()), ("error_kind", pa.string()),
    ]
)
_DDL = (
    "idx long, name string, lat double, lon double, country string, class int, population long, admin1_code string, admin1_name string, admin2_code string, admin2_name string, "
    "localized map<string,string>, source_date string, attribution string, file string, error_kind string"
)


class Bad(ValueError):
    """A file that cannot be read; ``kind`` is syntax, unsupported or checksum."""

    def __init__(self, kind: str, detail: str):
        super().__init__(detail)
        self.kind = kind


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise Bad("syntax", f"cut off at payload byte {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        value = shift = 0
        while True:
            (byte,) = self.take(1)
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                break
            if shift >= 70:
                raise Bad("syntax", f"a number of over ten bytes at payload byte {self.at}")
        if value >= 1 << 64:
            raise Bad("syntax", f"a number of over 64 bits at payload byte {self.at}")
        return value

    def below(self, limit: int) -> int:
        value = self.number()
        if value >= limit:
            raise Bad("syntax", f"{value} is not below {limit}")
        return value

    def many(self, least: int) -> range:
        """A count of entries that take at least ``least`` bytes each."""
        n = self.number()
        if n * least > len(self.data) - self.at:
            raise Bad("syntax", f"{n} entries do not fit into what is left")
        return range(n)

    def text(self) -> str:
        try:
            return self.take(self.number()).decode("utf-8")
        except UnicodeDecodeError:
            raise Bad("syntax", f"no UTF-8 before payload byte {self.at}") from None


def checked_payload(content: bytes) -> bytes:
    """The payload of a file whose header and checksum hold."""
    size = struct.calcsize(HEADER)
    if len(content) < size:
        raise Bad("syntax", "shorter than its header")
    magic, version, flags, length, crc = struct.unpack(HEADER, content[:size])
    if magic != MAGIC:
        raise Bad("syntax", "not a gazetteer file")
    if version != VERSION or flags:
        raise Bad("unsupported", f"version {version}, flags {flags}")
    if length != len(content) - size:
        raise Bad("syntax", f"{length} bytes stated, {len(content) - size} there")
    if zlib.crc32(content[size:]) != crc:
        raise Bad("checksum", "the payload is not what was written")
    return content[size:]


def decoded(content: bytes) -> tuple[str, str, list[dict]]:
    """Source date, attribution and places of a file. Nothing of a bad file is returned."""
    r = _Bytes(checked_payload(content))
    date, credit = r.text(), r.text()
    pool = [r.text() for _ in r.many(1)]
    tags = [r.text() for _ in r.many(1)]
    for tag in tags:
        if not is_language_tag(tag):
            raise Bad("syntax", f"{tag!r} is no language")
    divisions = [[(pool[r.below(len(pool))], pool[r.below(len(pool))]) for _ in r.many(2)] for _ in range(2)]
    places = []
    for k in r.many(16):
        lat, lon = struct.unpack("<ii", r.take(8))
        if abs(lat) > 9_000_000 or abs(lon) > 18_000_000:
            raise Bad("syntax", f"place {k} is off the globe")
        name, country, (kind,) = pool[r.below(len(pool))], r.take(2), r.take(1)
        if not name or not re.fullmatch(rb"[A-Z]{2}", country) or kind >= CLASSES:
            raise Bad("syntax", f"place {k} has no name, country or class")
        population = r.number()
        if population >= 1 << 63:
            raise Bad("unsupported", f"place {k} has a population of over 63 bits")
        place = {"idx": k, "name": name, "lat": lat / 1e5, "lon": lon / 1e5, "country": country.decode(), "class": kind, "population": population or None}
        for n, table in enumerate(divisions, 1):
            at = r.below(len(table) + 1)
            place[f"admin{n}_code"], place[f"admin{n}_name"] = table[at - 1] if at else (None, None)
        local: dict[str, str] = {}
        for _ in r.many(2):
            tag, other = tags[r.below(len(tags))], pool[r.below(len(pool))]
            local.setdefault(tag, other)
        place["localized"] = list(local.items())
        places.append(place)
    if r.at != len(r.data):
        raise Bad("syntax", f"{len(r.data) - r.at} bytes after the last place")
    return date, credit, places


def read_place_files(spark: SparkSession, path: str) -> DataFrame:
    """The places of all gazetteer files at ``path`` (a file, folder or pattern, wherever Spark can read), a row each.

    idx counts from 0 in each file. A file that cannot be read gives one row with its error_kind (syntax, unsupported, checksum) and
    no place. A task holds one file at a time and hands its places on in batches.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    date, credit, places = decoded(content.as_py())
                except Bad as e:
                    yield pa.RecordBatch.from_pylist([{"file": name, "error_kind": e.kind}], schema=_PLACE)
                    continue
                for k in range(0, len(places), 10_000):
                    yield pa.RecordBatch.from_pylist([p | {"source_date": date, "attribution": credit, "file": name} for p in places[k : k + 10_000]], schema=_PLACE)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, _DDL)


def open_place_files(spark: SparkSession, path: str) -> DataFrame:
    """The places at ``path`` for lookups; an error if any file is bad. idx is made distinct over files, in the order of their names."""
    from geoloom.operators.tables import written

    rows = written(read_place_files(spark, path))
    bad = rows.where("error_kind IS NOT NULL").select("file", "error_kind").limit(5).collect()
    if bad:
        raise ValueError(f"not gazetteers: {[tuple(r) for r in bad]}")
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))  # a row per file
    from pyspark.sql import Window as W

    starts = sizes.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return rows.join(starts, "file").withColumn("idx", F.col("idx") + F.col("start")).drop("start", "error_kind", "file")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encoded(places: list[dict], source_date: str, attribution: str, languages: list[str]) -> bytes:
    """A file of the places, in their order. Names in other languages than ``languages`` are left out."""
    pool: dict[str, int] = {}
    number = lambda s: pool.setdefault(s, len(pool))
    text = lambda s: _varint(len(s.encode())) + s.encode()
    tables: list[dict[tuple[str, str], int]] = [{}, {}]
    body = bytearray()
    for p in places:
        lat, lon = round(p["lat"] * 1e5), round(p["lon"] * 1e5)
        if abs(lat) > 9_000_000 or abs(lon) > 18_000_000 or not p["name"] or not re.fullmatch("[A-Z]{2}", p["country"]) or not 0 <= p["class"] < CLASSES:
            raise ValueError(f"no place for a file: {p['name']!r}")
        body += struct.pack("<ii", lat, lon) + _varint(number(p["name"])) + p["country"].encode() + bytes([p["class"]]) + _varint(max(0, p["population"] or 0))
        for n, table in enumerate(tables, 1):
            of = p[f"admin{n}_name"]
            body += _varint(0 if of is None else table.setdefault((p[f"admin{n}_code"] or "", of), len(table)) + 1)
        local = [(languages.index(t), s) for t, s in sorted(dict(p["localized"] or {}).items()) if t in languages]
        body += _varint(len(local)) + b"".join(_varint(k) + _varint(number(s)) for k, s in local)
    divisions = b"".join(_varint(len(t)) + b"".join(_varint(number(code)) + _varint(number(name)) for code, name in t) for t in tables)
    strings = _varint(len(pool)) + b"".join(map(text, pool))
    payload = text(source_date) + text(attribution) + strings + _varint(len(languages)) + b"".join(map(text, languages)) + divisions + _varint(len(places)) + bytes(body)
    return struct.pack(HEADER, MAGIC, VERSION, 0, len(payload), zlib.crc32(payload)) + payload


def encode_place_files(places: DataFrame, source_date: str, attribution: str, languages: list[str] | None = None, per_file: int = 100_000) -> DataFrame:
    """``places`` (idx and the columns of a gazetteer) as files of ``per_file`` idx each: name, content. A task holds one file's places."""
    tags = [t.lower() for t in languages or []]
    if not all(map(is_language_tag, tags)):
        raise ValueError(languages)
    columns = ["idx", "name", "lat", "lon", "country", "class", "population", "admin1_code", "admin1_name", "admin2_code", "admin2_name", "localized"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"name": f"places-{number:08d}.gaz", "content": encoded(held, source_date, attribution, tags)}], schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))

        number, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if row.pop("_file") != number:
                    if held:
                        yield done()
                    number, held = row["idx"] // per_file, []
                held.append(row)
        if held:
            yield done()

    rows = places.select(F.floor(F.col("idx") / per_file).alias("_file"), *columns)
    return rows.repartition("_file").sortWithinPartitions("_file", "idx").mapInArrow(write, "name string, content binary")


class BinaryFolder(DataSource):
    """Writes rows (name, content) as files of a folder that the driver and all executors share: option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "geoloom_binary_folder"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FolderWriter(self.options["path"].removeprefix("file://"))


class _FolderWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows) -> WriterCommitMessage:
        made = []
        os.makedirs(self.folder, exist_ok=True)
        for row in rows:
            part = os.path.join(self.folder, f".{row.name}-{uuid.uuid4().hex}")
            with open(part, "wb") as out:
                out.write(row.content)
            made.append((part, row.name))
        return _Made(made)

    def commit(self, messages) -> None:
        """Files appear under their names only when all tasks have ended; those of attempts that failed never do."""
        for m in messages:
            for part, name in m.files if m else ():
                os.replace(part, os.path.join(self.folder, name))

    def abort(self, messages) -> None:
        for m in messages:
            for part, _ in m.files if m else ():
                os.unlink(part)


class _Made(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def write_place_files(places: DataFrame, path: str, source_date: str, attribution: str, languages: list[str] | None = None, per_file: int = 100_000) -> None:
    """:func:`encode_place_files` into a shared folder, all files or none under their names."""
    spark = places.sparkSession
    spark.dataSource.register(BinaryFolder)
    encode_place_files(places, source_date, attribution, languages, per_file).write.format(BinaryFolder.name()).mode("append").save(path)
