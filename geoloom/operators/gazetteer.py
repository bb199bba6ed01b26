"""A gazetteer as a table of places: made from GeoNames files, kept as Parquet, looked up by position.

Places: idx, geoname_id, name, lat, lon, country, class (0 section to 6 capital), population (null: unknown), admin1_code,
admin1_name, admin2_code, admin2_name, localized MAP<language, name>.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geodesic import geodesic_distance
from geoloom.operators.aggregates import dense_number
from geoloom.operators.joins import reverse_lookup

# Feature codes and their classes; codes of abandoned and historic places, which are left out.
CLASSES = {"PPLC": 6, "PPLG": 6, "PPLA": 5, "PPLA2": 4, "PPLA3": 3, "PPLA4": 2, "PPLA5": 2, "PPLX": 0}
GONE, LOCALITY = ("PPLH", "PPLQ", "PPLW"), 1


def is_language_tag(tag: str) -> bool:
    """Whether a string has the shape of a language tag: two to eight letters, then parts of letters and digits."""
    return bool(re.fullmatch("[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*", tag))


def language_tag(tag: Column) -> Column:
    return tag.rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$")


def language_positions(held: list[str], requested: list[str]) -> list[int]:
    """Places in ``held`` that requested tags resolve to, in order: the tag itself, else its primary language; each once."""
    low, out = [t.lower() for t in held], []
    for tag in requested:
        for wanted in (tag.lower(), tag.lower().split("-")[0]):
            if wanted in low:
                out += [low.index(wanted)] if low.index(wanted) not in out else []
                break
    return out


def feature_class(code: Column) -> Column:
    """Class of a populated place's feature code; null for places that are gone."""
    out = F.when(code.isin(*GONE), None)
    for name, number in CLASSES.items():
        out = out.when(code == name, number)
    return out.otherwise(LOCALITY)


def alternate_rank(preferred: Column, short: Column, colloquial: Column, historic: Column) -> Column:
    """3 for a preferred name, 2 for a plain one (or one both preferred and short), 1 for a short one; null for others."""
    on = lambda x: F.coalesce(x == "1", F.lit(False))
    return F.when(on(colloquial) | on(historic), None).when(on(preferred) & ~on(short), 3).when(~on(short), 2).when(on(preferred), 1).otherwise(1)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A GeoNames file with columns _c0, _c1, ...: tabs, no quotes, lines that begin with # left out."""
    return spark.read.csv(path, sep="\t", quote="", comment="#", nullValue="")


def from_geonames(cities: DataFrame, admin1: DataFrame, admin2: DataFrame, alternates: DataFrame | None = None, languages: list[str] | None = None) -> DataFrame:
    """The places of GeoNames tables (all text, columns _c0, _c1, ... in the files' order).

    Kept are populated places that still are, with a name and a two-letter country; positions are cut to five decimals. A row off the globe
    is left out. Of a place's names in a language the best ranked stays, of equals the one with the lower id. Numbered from 0 by geoname_id.
    """
    tags = [t.lower() for t in languages or []]
    if not all(map(is_language_tag, tags)):
        raise ValueError(languages)
    fixed = lambda x: F.round(x.try_cast("double") * 1e5) / 1e5
    c = lambda k: F.col(f"_c{k}")
    rows = cities.where(c(8).rlike("^[A-Z]{2}$") & (c(6) == "P") & (c(1) != "")).select(
        c(0).try_cast("bigint").alias("geoname_id"), c(1).alias("name"), fixed(c(4)).alias("lat"), fixed(c(5)).alias("lon"), c(8).alias("country"), feature_class(c(7)).alias("class"),
        c(14).try_cast("bigint").alias("population"), c(10).alias("admin1_code"), c(11).alias("admin2_code"),
    )
    rows = rows.where("geoname_id IS NOT NULL AND class IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
    rows = rows.withColumn("population", F.when(F.col("population") > 0, F.col("population")))
    one, two = (a.select(F.col("_c0").alias(f"_k{n}"), F.col("_c1").alias(f"admin{n}_name")).dropDuplicates([f"_k{n}"]) for n, a in ((1, admin1), (2, admin2)))
    rows = rows.withColumn("_k1", F.concat_ws(".", "country", F.coalesce("admin1_code", F.lit(""))))
    rows = rows.withColumn("_k2", F.concat_ws(".", "_k1", F.coalesce("admin2_code", F.lit(""))))
    rows = rows.join(one, "_k1", "left").join(two, "_k2", "left").drop("_k1", "_k2")
    for n in (1, 2):
        rows = rows.withColumn(f"admin{n}_code", F.when(F.col(f"admin{n}_name").isNotNull(), F.col(f"admin{n}_code")))
    empty = F.create_map().cast("map<string,string>")
    if alternates is None or not tags:
        rows = rows.withColumn("localized", empty)
    else:
        names = alternates.select(
            c(0).try_cast("bigint").alias("_alt"), c(1).try_cast("bigint").alias("geoname_id"), F.lower(c(2)).alias("tag"), c(3).alias("alt"),
            alternate_rank(c(4), c(5), c(6), c(7)).alias("rank"),
        ).where(F.col("tag").isin(*tags) & F.col("rank").isNotNull() & (F.col("alt") != ""))
        best = names.groupBy("geoname_id", "tag").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "_alt", "alt"))["alt"].alias("alt"))
        by_place = best.groupBy("geoname_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "alt")))).alias("localized"))
        rows = rows.join(by_place, "geoname_id", "left").withColumn("localized", F.coalesce("localized", empty))
    order = ["idx", "geoname_id", "name", "lat", "lon", "country", "class", "population", "admin1_code", "admin1_name", "admin2_code", "admin2_name", "localized"]
    return dense_number(rows, "geoname_id", "idx").select(*order)


def write_places(places: DataFrame, path: str) -> None:
    """Keep a gazetteer as Parquet."""
    places.write.parquet(path)


def open_places(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer from where it is kept; an error for a table that is none."""
    found = spark.read.parquet(path)
    lacking = {"idx", "name", "lat", "lon", "country", "class", "population"} - set(found.columns)
    if lacking:
        raise ValueError(f"not a gazetteer, without {sorted(lacking)}")
    return found


def localized_name(localized: Column, tag: str) -> Column:
    """A place's name in a language, whatever the tag's case; null if it has none."""
    low = F.transform_keys(localized, lambda k, _: F.lower(k))
    return F.try_element_at(low, F.lit(tag.lower()))


def place(name: Column, lat: Column, lon: Column, country: Column, query_lat: Column, query_lon: Column, query_error_m: Column | float = 0.0) -> Column:
    """STRUCT<name, lat, lon, country, distance_m, max_error_m> of a place seen from a position; null for a blank name, a country that is
    not two capitals, or a place off the globe."""
    ok = (F.trim(name) != "") & country.rlike("^[A-Z]{2}$") & lat.between(-90, 90) & lon.between(-180, 180)
    bound = query_error_m if isinstance(query_error_m, Column) else F.lit(float(query_error_m))
    return F.when(
        ok,
        F.struct(name.alias("name"), lat.alias("lat"), lon.alias("lon"), country.alias("country"), geodesic_distance(query_lat, query_lon, lat, lon).alias("distance_m"), bound.alias("max_error_m")),
    )


def with_admin(p: Column, level: int, code: Column, name: Column) -> Column:
    return p.withField(f"admin{level}_code", code).withField(f"admin{level}_name", name)


def reverse(
    queries: DataFrame, places: DataFrame, max_distance_m: float = 50_000.0, min_population: int = 0, min_class: int = 0, languages: list[str] | None = None
) -> DataFrame:
    """The nearest admissible place of each query (qid, lat, lon) as a row of its own: qid, place_idx, distance_m, name, country,
    admin1_name, admin2_name, class, population and shown (the first name there is in ``languages``, else its own)."""
    met = reverse_lookup(queries, places, max_distance_m, min_population, min_class)
    shown = F.coalesce(*[localized_name(F.col("localized"), t) for t in languages or []], F.col("name"))
    facts = places.select(F.col("idx").alias("place_idx"), "name", "country", "admin1_name", "admin2_name", "class", "population", shown.alias("shown"))
    return met.join(facts, "place_idx", "left").select("qid", "place_idx", "distance_m", "name", "country", "admin1_name", "admin2_name", "class", "population", "shown")

