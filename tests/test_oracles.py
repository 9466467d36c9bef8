"""Every named query with SQL agrees with it on the smallest tables."""

import pytest
from check_oracles import compare, connect

from tidewatch.plans import ORACLES, QUERIES, flagship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], FOLDER) == []


def test_flagship_runs(spark):
    assert flagship(spark, FOLDER).columns == ["event_id", "label", "window"]
