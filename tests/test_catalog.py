"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from framewright.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in want.columns)) for r in df.collect())
    assert rows == sorted(repr(tuple(r)) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
