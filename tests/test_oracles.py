"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_sql(spark, connection, name):
    ok, info = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert ok, info


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["query_id", "rank"] and df.count() > 0
