"""Every registered query that SQL can express gives the rows of its SQL, and the others run."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from geoloom.plans.queries import ORACLE_SQL, QUERIES

SF_DIR = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in SF_DIR.glob("*.parquet"):
        where = f"{table}/*.parquet" if table.is_dir() else table
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(value: object) -> object:
    """Values as both engines can hold them; floats to 12 significant digits, as their last bits may differ."""
    if isinstance(value, float):
        return 0.0 if value == 0 else value if not math.isfinite(value) else float(f"{value:.12g}")
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") and value.tzinfo else value


def rows(columns: list[str], found: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted(([plain(r[k]) for k in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_of_the_sql(spark, duck, name):
    want = duck.execute(ORACLE_SQL[name])
    columns, theirs = rows([d[0] for d in want.description], want.fetchall())
    got = QUERIES[name](spark, str(SF_DIR))
    assert rows(got.columns, got.collect()) == (columns, theirs)
    assert theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF_DIR)).count() > 0
