"""Every registered query against its DuckDB equivalent on the smallest tables."""

import oracle
import pytest
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_backbones_beat_the_mean(spark):
    rows = QUERIES["M3_ridge"](spark, SF).collect()
    assert all(r["mae"] < 0.05 for r in rows)


def test_loaded_bundle_agrees(spark):
    assert all(r["maximum_difference"] == 0.0 for r in QUERIES["M4_frozen_bundle"](spark, SF).collect())
