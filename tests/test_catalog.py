"""Every registered query against its SQL twin, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tools.check import TABLES, connect, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(TABLES) == 14 and duckdb.__version__


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    result = connect(SF_DIR).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(result.fetchall(), names)
