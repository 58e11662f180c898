"""The SQL of the operators against their queries."""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, connect

from lexdrift.llm import queries
from lexdrift.llm.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], ORACLES[name])
    assert ok, note
