"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert differences(spark, db, name, QUERIES[name], SQL[name], SF_DIR) == []


def test_every_query_has_sql():
    assert QUERIES.keys() - entry.LLM_QUERIES.keys() == SQL.keys() - entry.LLM_SQL.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
