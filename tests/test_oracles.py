"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pytest

from scriptloom.plans import plan_queries, profile_queries, unit_queries, verify_queries  # noqa: F401
from scriptloom.plans.registry import ORACLES, QUERIES
from scriptloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"


def tidy(row):
    return repr(tuple(round(x, 6) if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.datetime) else x for x in row))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = sorted(tidy(r) for r in found.select(expected.columns).collect())
    assert rows == sorted(tidy(r) for r in expected.fetchall())
