"""Every registered query against its oracle on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from shardweave import plans

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, shape  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(plans.queries()) == set(plans.oracle_sql())
    assert set(plans.queries()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row.n == 1500


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = shape(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    want = shape([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
