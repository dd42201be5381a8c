"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from piisieve.plans.check import compare, duck
from piisieve.plans.queries import QUERIES

from conftest import SF_SMALL

SQLS = E.oracle_sql()
NAMES = list(QUERIES)      # corpus queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


ROWS_ONLY = {"model_stats_approx"}  # approximate quantiles


def test_every_query_has_an_oracle():
    assert set(NAMES) - set(SQLS) == ROWS_ONLY


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, E.queries()[name], SQLS.get(name), SF_SMALL)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["entity_type", "total", "verified", "rejected", "verification_rate"]
    assert df.count() >= 0
