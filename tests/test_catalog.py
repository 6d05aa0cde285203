"""Every query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tidepanel import catalog, catalog_daily, catalog_models  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        return round(float(x), 5) if isinstance(x, float) else x

    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


def alike(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_says_what_its_sql_says(spark, duck, name):
    ours = catalog.QUERIES[name](spark, FOLDER)
    theirs = duck.sql(catalog.SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = plain(ours.collect(), ours.columns), plain(theirs.fetchall(), theirs.columns)
    assert len(a) == len(b)
    assert all(alike(x, y) for p, q in zip(a, b) for x, y in zip(p, q))
