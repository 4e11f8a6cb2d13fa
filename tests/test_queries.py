"""Every query of the catalog against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from feedsieve.plans.catalog import ORACLES, QUERIES

# Their right answer is no rows.
EMPTY = {"run_without_posts"}


@pytest.fixture(scope="module")
def duck():
    from conftest import SF_DIR

    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table = name.split(".")[0]
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{name}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    got = sorted(repr(tuple(row)) for row in df.select(*columns).collect())
    places = [relation.columns.index(column) for column in columns]
    expected = sorted(repr(tuple(row[p] for p in places)) for row in relation.fetchall())
    assert got == expected
    assert bool(got) == (name not in EMPTY)


def test_entry(spark):
    rows = {row.is_job_post: row.posts for row in entry_points.entry(spark).collect()}
    assert rows == {True: 100, False: 100}
