"""Gazetteer files: a round trip over several files, files that are bad in one way each, and the bytes of a small file."""

from __future__ import annotations

import struct
import zlib

import pytest

from geoloom.sources import placefile as G

KIND = "idx long, name string, lat double, lon double, country string, class int, population long, admin1_code string, admin1_name string, admin2_code string, admin2_name string, localized map<string,string>"
ROWS = [
    (0, "Ürümqi", 43.80096, 87.60046, "CN", 5, 3029372, "13", "Xinjiang", None, None, {"fr": "Ouroumtsi", "zh-hans": "乌鲁木齐"}),
    (1, "A", -90.0, -180.0, "AQ", 0, None, None, None, None, None, {}), (2, "B" * 200, 90.0, 180.0, "ZZ", 6, 1 << 40, "1", "One", "2", "Two", {"fr": "Bé"}), (3, "A", 0.00001, -0.00001, "FR", 1, 5, "1", "One", None, None, {}),
    (7, "Last", 1.5, 2.5, "DE", 2, 128, None, None, "9", "Nine", {}),
]


def sealed(payload: bytes, version: int = 1, flags: int = 0, crc: int | None = None) -> bytes:
    return struct.pack("<4sHHII", b"GCGZ", version, flags, len(payload), zlib.crc32(payload) if crc is None else crc) + payload


#: Empty date and credit, no strings, languages or divisions, no places.
EMPTY = b"\0" * 7
#: One place "Q" (the only string) of class 4 at 1 / -1 in 1e-5 degrees, population 300, no divisions, no other names.
ONE = b"\x011" + b"\x01c" + b"\x01\x01Q" + b"\0" + b"\0\0" + b"\x01" + struct.pack("<ii", 1, -1) + b"\0" + b"XY" + b"\x04" + b"\xac\x02" + b"\0\0\0"


def test_round_trip(spark, tmp_path):
    places = spark.createDataFrame(ROWS, KIND)
    G.write_place_files(places, str(tmp_path / "out"), "2024-01-31", "from us", ["fr", "zh-Hans"], per_file=2)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"places-{k:08d}.gaz" for k in (0, 1, 3)]
    got = sorted(G.open_place_files(spark, str(tmp_path / "out")).collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == [0, 1, 2, 3, 4] and {(r.source_date, r.attribution) for r in got} == {("2024-01-31", "from us")}
    columns = [k.split()[0] for k in KIND.split(", ")][1:]
    assert [tuple(r[k] for k in columns) for r in got] == [r[1:] for r in ROWS]


def test_bytes_of_small_files():
    assert G.decoded(sealed(EMPTY)) == ("", "", []) and G.encoded([], "", "", []) == sealed(EMPTY)
    date, credit, (place,) = G.decoded(sealed(ONE))
    assert (date, credit, place["name"], place["lat"], place["lon"], place["country"], place["class"], place["population"]) == ("1", "c", "Q", 1e-5, -1e-5, "XY", 4, 300)
    assert G.encoded([place | {"localized": {}}], "1", "c", []) == sealed(ONE)


BAD = {
    "syntax": [b"", b"GCGZ", b"NOPE" + sealed(EMPTY)[4:], sealed(EMPTY) + b"\0", sealed(EMPTY)[:-1], sealed(EMPTY + b"\0"), sealed(EMPTY[:-1]), sealed(b"\x05ab"), sealed(b"\x01\xff" + EMPTY[1:]), sealed(b"\xff" * 11 + EMPTY),
               sealed(ONE.replace(b"XY", b"Xy")), sealed(ONE.replace(b"XY\x04", b"XY\x07")), sealed(ONE.replace(struct.pack("<i", 1), struct.pack("<i", 9_000_001), 1)), sealed(ONE.replace(b"\x01\x01Q", b"\x01\0")), sealed(b"\0\0\0\x01\x01!\0\0\0")],
    "unsupported": [sealed(EMPTY, version=2), sealed(EMPTY, flags=1)],
    "checksum": [sealed(EMPTY, crc=5), sealed(ONE)[:-1] + b"\x01"],
}


@pytest.mark.parametrize("kind,content", [(k, c) for k, cs in BAD.items() for c in cs])
def test_bad_files_say_how(kind, content):
    with pytest.raises(G.Bad) as e:
        G.decoded(content)
    assert e.value.kind == kind


def test_bad_files_among_good_ones(spark, tmp_path):
    (tmp_path / "a.gaz").write_bytes(sealed(ONE))
    (tmp_path / "b.gaz").write_bytes(sealed(ONE, crc=1))
    rows = G.read_place_files(spark, f"{tmp_path}/*.gaz").collect()
    assert sorted((r.file[-5:], r.name, r.error_kind) for r in rows) == [("a.gaz", "Q", None), ("b.gaz", None, "checksum")]
    with pytest.raises(ValueError, match="checksum"):
        G.open_place_files(spark, str(tmp_path))


def test_places_that_no_file_takes(spark):
    for change in ({"lat": 91.0}, {"name": ""}, {"country": "fr"}, {"class": 7}):
        row = dict(zip([k.split()[0] for k in KIND.split(", ")], ROWS[3])) | change
        with pytest.raises(ValueError):
            G.encoded([row], "", "", [])
    with pytest.raises(ValueError):
        G.encode_place_files(spark.createDataFrame(ROWS, KIND), "", "", ["not a tag"])
