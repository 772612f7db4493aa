"""Every registered query against its SQL on the smallest scale; the driver repeats this at a larger one."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from scripts.check_queries import TABLES, compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in TABLES:
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    c.execute("SET TimeZone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    state, _, _, note = compare(spark, con, SF_DIR, name, queries()[name], oracle_sql().get(name))
    assert state in ("ok", "rows-only"), f"{name}: {state} {note}"


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
