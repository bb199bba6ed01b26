"""Known values of formatting, sentences, URIs and grid codes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geoloom.functions import core, grids, text
from geoloom.sources.freetext import parse_text
from geoloom.sources.sentences import parse_geo_uri, parse_nmea
from geoloom.streaming.cells import arrived, windowed_cells

# Positions and their references.
MGRS = [
    (40.0, -75.0, "18TWK0000027757"), (48.8584, 2.2945, "31UDQ4825211954"), (-33.8568, 151.2153, "56HLH3490052288"),
    (60.0, 5.0, "32VKM7697958157"), (0.0, 0.0, "31NAA6602100000"), (-1.0, -1.0, "30MYD2256189402"), (82.0, 20.0, "33XWM7759308183"),
]


def test_mgrs(spark):
    rows = spark.createDataFrame([*MGRS, (90.0, 0.0, "ZAH0000000000"), (-90.0, 0.0, "BAN0000000000"), (None, 1.0, None)], "lat double, lon double, want string")
    got = rows.select("want", grids.mgrs("lat", "lon").alias("m"), grids.mgrs("lat", "lon", 0).alias("square")).collect()
    assert [r.m for r in got] == [r.want for r in got]
    assert [r.square for r in got if r.want] == [r.want[:-10] for r in got if r.want]


def test_s2(spark):
    rows = spark.createDataFrame([(40.7128, -74.006), (0.0, 0.0)], "lat double, lon double")
    got = [r[0] for r in rows.select(grids.s2_cell("lat", "lon", 20)).collect()]
    assert got[0] % 2**64 == 9_926_595_630_970_437_632
    first = rows.limit(1)
    for level in (0, 1, 15, 29, 30):
        cell = first.select(grids.s2_cell("lat", "lon", level).alias("c")).select("c", grids.s2_level(F.col("c")).alias("l")).first()
        assert cell.l == level
        if level < 20:
            low = 1 << 2 * (30 - level)
            assert (got[0] % 2**64) & -low | low == cell.c % 2**64


def test_text(spark):
    rows = spark.createDataFrame([(40.7128, -74.006), (-1e-9, 1e-9), (0.999999999, -59.99999999), (None, 1.0)], "lat double, lon double")
    got = rows.select(
        text.format_dd("lat", "lon").alias("dd"), text.format_dd("lat", "lon", separator=",").alias("comma"), text.format_dd("lat", "lon", 2, cardinal=True).alias("short"),
        text.format_dms("lat", "lon").alias("dms"), text.format_ddm("lat", "lon", symbols="ascii", cardinal=False).alias("ddm"),
        text.format_fix(core.fix(core.coordinate("lat", "lon"), core.accuracy("OneSigma", 1000.0))).alias("fix"),
    ).collect()
    assert tuple(got[0]) == ("40.712800, -74.006000", "40,712800 -74,006000", "40.71 N, 74.01 W", "40°42′46.08″N 74°00′21.60″W", "40°42.768' -74°00.360'", "40.71, -74.01")
    assert tuple(got[1])[:5] == ("0.000000, 0.000000", "0,000000 0,000000", "0.00 N, 0.00 E", "0°00′00.00″N 0°00′00.00″E", "0°00.000' 0°00.000'")
    assert got[2].dms == "1°00′00.00″N 60°00′00.00″W"
    assert tuple(got[3]) == (None,) * 6
    with pytest.raises(ValueError):
        text.format_dd("lat", "lon", 16)


def test_separators():
    tags = {"de-DE": ",", "de-CH": ".", "en-US": ".", "de_Latn_ch": ".", "es-419": ",", "": ".", "PT": ","}
    assert {t: text.separator_for_locale(t) for t in tags} == tags


def sentence(*fields: str, sign: str | None = "") -> str:
    """Fields joined and signed with the exclusive or of their bytes; another ``sign`` takes its place, and None leaves it out."""
    body, total = ",".join(fields), 0
    for byte in body.encode():
        total ^= byte
    return f"${body}" if sign is None else f"${body}*{sign or f'{total:02X}'}"


def gga(talker: str = "GN", lat: str = "5132.4000", ns: str = "N", lon: str = "00007.2000", ew: str = "W", quality: str = "2", hdop: str = "1.2", alt: str = "35.7", unit: str = "M", geoid: str = "47.0", sign: str | None = "") -> str:
    return sentence(f"{talker}GGA", "081530.00", lat, ns, lon, ew, quality, "10", hdop, alt, unit, geoid, "M", "", "", sign=sign)


def rmc(time: str = "081530.25", status: str = "A", date: str = "170721", mode: str = "A") -> str:
    return sentence("GPRMC", time, status, "3330.0000", "S", "07040.5000", "W", "0.4", "12.0", date, "", "", mode)


def gll(lat: str, lon: str, status: str = "A", mode: str = "D") -> str:
    return sentence("GLGLL", lat, "S", lon, "E", "235900", status, mode)


# What a field may hold by its rule, and one case for each way of breaking it.
HERE, SOUTH, FAULT = (51.54, -0.12), (-33.5, -(70 + 40.5 / 60)), lambda kind: (None,) * 5 + (kind,)
NMEA = [
    (gga(), (*HERE, 35.7, 6.0, None, None)), (gga(sign=None), (*HERE, 35.7, 6.0, None, None)), (gga(hdop="", alt="", unit="", geoid=""), (*HERE, None, None, None, None)), (gga("QZ", alt="-3.5"), (*HERE, -3.5, 6.0, None, None)),
    (gga(sign="00"), FAULT("Checksum")), (gga(sign="5"), FAULT("Checksum")), (gga(sign="GG"), FAULT("Checksum")), (gga(quality="0"), FAULT("NoFix")), (gga(unit="K"), FAULT("Syntax")), (gga(hdop="-0.5"), FAULT("Syntax")), (gga(alt="high"), FAULT("Syntax")),
    (gga(lat="5160.0000"), FAULT("Syntax")), (gga(lat="532.4"), FAULT("Syntax")), (gga(lat=""), FAULT("Syntax")), (gga(ns="E"), FAULT("Syntax")), (gga(lon="0007.2"), FAULT("Syntax")), (gga(ew=""), FAULT("Syntax")),
    (rmc(), (*SOUTH, None, None, datetime(2021, 7, 17, 8, 15, 30, 250000), None)), (rmc("235960", date="301216"), (*SOUTH, None, None, datetime(2016, 12, 31), None)), (rmc(date="010180"), (*SOUTH, None, None, datetime(1980, 1, 1, 8, 15, 30, 250000), None)),
    (rmc(date="310621"), (*SOUTH, None, None, None, None)), (rmc("251530"), (*SOUTH, None, None, None, None)), (rmc(date=""), (*SOUTH, None, None, None, None)), (rmc(status="V"), FAULT("NoFix")), (rmc(mode="N"), FAULT("NoFix")),
    (gll("0115.0000", "17959.4000"), (-1.25, 179.99, None, None, None, None)), (gll("0115.0000", "17959.4000", "V"), FAULT("NoFix")), (gll("0115.0000", "17959.4000", mode="N"), FAULT("NoFix")), (gll("0115.0000", "18030.0000"), (-1.25, 180.5, None, None, None, "OutOfRange")),
    (sentence("GPZDA", "081530", "17", "07", "2021", "00", "00"), FAULT("Unsupported")), ("", FAULT("Unsupported")),
]


def test_nmea(spark):
    rows = spark.createDataFrame([(s,) for s, _ in NMEA], "t string").select("t", parse_nmea(F.col("t")).alias("p"))
    got = rows.select("t", "p.lat", "p.lon", "p.height_m", "p.horizontal_m", "p.ts", "p.error_kind").collect()
    wrong = [(tuple(r), want) for r, (t, want) in zip(got, NMEA, strict=True) if r[0] != t or not _close(tuple(r)[1:], want)]
    assert not wrong


URIS = [
        (" geo:48.2,16.3", (48.2, 16.3, None, None, None)), ("GEO:48.2,16.3,183;CRS=WGS84;u=40;x=1", (48.2, 16.3, 183.0, 40.0, None)),
        ("geo:48.2", (None,) * 4 + ("Syntax",)), ("geo:48.2,16.3;crs=nad27", (None,) * 4 + ("Unsupported",)), ("geo:91,16.3", (91.0, 16.3, None, None, "OutOfRange")),
        ("geo:1,2;u=5;crs=nad27", (None,) * 4 + ("Syntax",)), ("geo:1,2;", (None,) * 4 + ("Syntax",)), ("geo:1,2,3,4", (None,) * 4 + ("Syntax",)),
        ("geo:1,2;u=-1", (None,) * 4 + ("Syntax",)), ("geo:1,2;u", (None,) * 4 + ("Syntax",)), ("geo:nan,2", (None,) * 4 + ("Syntax",)), ("", (None,) * 4 + ("Syntax",)),
]


def test_geo_uri(spark):
    rows = spark.createDataFrame([(s,) for s, _ in URIS], "t string").select("t", parse_geo_uri(F.col("t")).alias("p"))
    got = rows.select("t", "p.lat", "p.lon", "p.height_m", "p.horizontal_m", "p.error_kind").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == dict(URIS)


def test_null_texts(spark):
    got = spark.createDataFrame([(None,)], "t string").select(parse_nmea(F.col("t")).alias("a"), parse_geo_uri(F.col("t")).alias("b")).first()
    assert tuple(got) == (None, None)


def test_stream_leaves_late_fixes_out(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    for k, part in enumerate([[(at(0), 1.0, 1.0), (at(0, 30), 1.0, 1.0), (at(5), 1.0, 1.0), (None, 1.0, 1.0)], [(at(6), 1.0, 1.0)], [(at(0, 10), 1.0, 1.0), (at(9), 1.0, 1.0), (at(9), None, 1.0)]]):
        spark.createDataFrame(part, "ts timestamp, lat double, lon double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("ts timestamp, lat double, lon double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = arrived(windowed_cells(stream, 2)).orderBy("start").collect()
    assert [(r.start, r.n) for r in got] == [(at(0), 2), (at(5), 1), (at(6), 1)]


BAD = lambda kind: (None, None, None, None, kind)
NEW_YORK = (40 + 42 / 60 + 46 / 3600, -(74 + 22 / 3600), 1.0, None, None)
TEXTS = [
    ("40.7128, -74.006", (40.7128, -74.006, 0.7, "LatLon", None)), ("151.2 -33.9", (-33.9, 151.2, 0.9, "LonLat", None)),
    ("40°42′46″N 74°00′22″W", NEW_YORK), ("74°0'22\"W, 40°42'46\"N", NEW_YORK), ("N 40°42'46\" W 74°00'22\"", NEW_YORK), ("40d42m46sN 74d00m22sW", NEW_YORK),
    ("4042.766N, 07400.456W", (40 + 42.766 / 60, -(74 + 0.456 / 60), 1.0, None, None)), ("40.7N, 74.006", (40.7, 74.006, 0.9, None, None)),
    ("1234.5, 10", BAD("Ambiguous")), ("40.5 30, 10", BAD("Ambiguous")), ("4e1, 3e1", BAD("Ambiguous")), ("10d30m15S, 20E", (-(10 + 30 / 60 + 15 / 3600), 20.0, 1.0, None, None)),
    ("10d30m15SN 20E", (10 + 30 / 60 + 15 / 3600, 20.0, 1.0, None, None)), ("200, 0", (0.0, 200.0, None, None, "OutOfRange")),
    ("95°N 10°E", (95.0, 10.0, None, None, "OutOfRange")), ("10, 181E", (10.0, 181.0, None, None, "OutOfRange")), ("100, 150", (100.0, 150.0, None, None, "OutOfRange")),
    ("10N 20N", BAD("Syntax")), ("-10N 20E", BAD("Syntax")), ("10°60' 20", BAD("Syntax")), ("hello", BAD("Syntax")), ("", BAD("Syntax")), ("1, 2, 3", BAD("Syntax")), ("nan, inf", BAD("Syntax")),
    (" 48.8566, 2.3522 ", (48.8566, 2.3522, 0.7, "LatLon", None)), ("40º42′46″N\u00a074º0’22”\u202fW", NEW_YORK), ("-0, 0", (0.0, 0.0, 0.7, "LatLon", None)),
]


def _close(got, want):
    return all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-9) for a, b in zip(tuple(got), want, strict=True))


def test_free_text(spark):
    rows = spark.createDataFrame([(t,) for t, _ in TEXTS], "t string").select("t", parse_text(F.col("t")).alias("p"))
    wrong = [(r.t, tuple(r.p)) for r, (_, want) in zip(rows.collect(), TEXTS) if not _close(r.p, want)]
    assert not wrong
    comma = [("48,8566, 2,3522", 48.8566), ("48,8566; 2,3522", 48.8566), ("48,8566 2,3522", 48.8566), ("48,8566", None), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in comma], "t string").select(parse_text(F.col("t"), "LatLon", True).alias("p")).select("p.lat").collect()
    assert [r.lat for r in got] == [w for _, w in comma]
    first = spark.createDataFrame([("-74.006, 40.7128",), ("100, 150",)], "t string").select(parse_text(F.col("t"), "LonLat").alias("p")).collect()
    assert (first[0].p.lat, first[0].p.axis_order, first[1].p.lat) == (40.7128, "LonLat", 150.0)
