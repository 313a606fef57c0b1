"""Every registered query against its SQL twin."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from noteloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, con):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["piece_id", "pattern_string", "count"]
    assert result.count() > 0
