"""Corpus queries that have SQL, against DuckDB; the pipeline's registration."""

import pytest

import __spark_entry__ as E
from piisieve.llm.queries import QUERIES
from piisieve.plans.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_matches_oracle(spark, name):
    ok, message = compare(spark, duck(SF), *QUERIES[name], SF)
    assert ok, message


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(E.queries())
