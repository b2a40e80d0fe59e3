"""Every registered query equals its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from paths import SF001
from oracle_harness import compare, duckdb_con
from tallyman.plans.oracle import ORACLE
from tallyman.plans.queries import spark_queries

QUERIES = spark_queries()
ORACLES = {k: v for k, v in ORACLE.items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, SF001, name, QUERIES[name], ORACLES[name], verbose=True)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "variance_pct" in df.columns
