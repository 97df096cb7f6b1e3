"""Every bound query against its oracle SQL on the smallest tables."""

import os

import pytest
from oracle import compare, duck

import __spark_entry__ as driver

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
