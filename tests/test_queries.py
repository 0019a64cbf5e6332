"""Every registered query gives the same rows as its SQL twin."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from stratalake.plans.catalogue import QUERIES
from stratalake.plans.twins import TWINS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    result = QUERIES[name](spark, data)
    twin = duck.execute(TWINS[name])
    columns = [d[0] for d in twin.description]
    assert sorted(result.columns) == sorted(columns)
    names = sorted(columns)
    actual = sorted(tuple(plain(r[c]) for c in names) for r in result.collect())
    places = [columns.index(c) for c in names]
    expected = sorted(tuple(plain(r[i]) for i in places) for r in twin.fetchall())
    assert actual == expected
    assert actual, "a query without rows checks nothing"


def test_entry(spark):
    result = entry_module.entry(spark)
    assert "total_revenue" in result.columns
    assert not result.isEmpty()
