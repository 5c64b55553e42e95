"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from skeinlake.plans import catalogue

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "None"
    return str(value)


@pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, str(TABLES))
    found = [tuple(r) for r in df.collect()]
    if name not in catalogue.SQL:
        assert df.columns
        return
    told = sql.sql(catalogue.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(told.columns)
    rows = lambda rs, columns: sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in rs)
    assert rows(found, df.columns) == rows(told.fetchall(), told.columns)


def test_entry_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
