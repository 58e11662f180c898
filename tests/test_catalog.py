from __future__ import annotations

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__
from lexdrift.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert ok, note


def test_entry(spark):
    (row,) = __spark_entry__.entry(spark).collect()
    assert row["total_processed"] == 200
