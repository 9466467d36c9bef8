"""The queries with SQL against it on the smallest tables."""

import pytest
from check_oracles import compare, connect

from tidewatch.llm.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER) == []


def test_one_query_for_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
