"""Registered queries against their DuckDB twins on the smallest tables."""

import math

import duckdb
import pytest

from tidebook.plans import catalog, catalog_sql

QUERIES, SQL = catalog.queries(), catalog_sql.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(f"{float(value):.9g}")
    return str(value)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 70


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_twin(spark, db, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = db.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(([plain(r[k]) for k in at] for r in result.fetchall()), key=str)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    assert got == want
