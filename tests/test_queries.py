"""Every registered query that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from docketry.plans import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}".rstrip("0").rstrip(".")
    return str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
    assert set(queries.QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    found = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert rows


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0
