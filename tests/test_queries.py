"""Every registered query against its SQL, and queries without SQL for a stable, non-empty result."""

import pytest

import __spark_entry__ as driver
from tests.conftest import TESTDATA
from tests.oracle import compare, connect

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(TESTDATA)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["id", "core_dist", "is_core", "cluster_id"]
