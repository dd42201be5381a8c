"""Work on rows of a file with one row group is dealt to all cores; result files are parsed once."""

import json
import os

import duckdb
import pytest

from piisieve.operators import stats
from piisieve.plans import queries
from piisieve.sources import jsonl


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def one_group(tmpdir_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT range AS c_custkey, 'Customer#' || range AS c_name, CAST(range % 3 AS INTEGER) AS c_nationkey,
        range - 5.0 AS c_acctbal, CASE range % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' END AS c_mktsegment
        FROM range(4000)) TO '{tmpdir_path}/customer.parquet' (FORMAT parquet, ROW_GROUP_SIZE 100000)""")
    con.execute(f"COPY (SELECT CAST(range AS INTEGER) AS n_nationkey, 'N' || range AS n_name FROM range(2)) TO '{tmpdir_path}/nation.parquet'")
    return tmpdir_path


def test_customer_documents_are_dealt_evenly(spark, one_group):
    docs = queries._customer_docs(spark, one_group)
    sizes = docs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    cores = spark.sparkContext.defaultParallelism
    assert sum(sizes) == 4000 and len(sizes) >= 2 * cores
    assert max(sizes) <= 2 * 4000 / len(sizes) + 20


@pytest.fixture()
def result_files(tmpdir_path):
    rows = {0: [("a", 1.0, True), ("b", 2.0, False)], 1: [("c", 3.0, True), ("d", 5.0, None)], 2: [("e", 7.0, False)]}
    for k, lines in rows.items():
        folder = f"{tmpdir_path}/file={k} x+%.jsonl"
        os.makedirs(folder)
        with open(f"{folder}/part-0.json", "w") as f:
            f.write("\n \n{broken\n{\"recordId\":\"z\"} 5\n")
            for i, ms, ok in lines:
                f.write(" \t" + json.dumps({"recordId": i, "result": {"verified": ok, "confidence": 0.5, "latencyMs": ms},
                                            "model": {"name": f"m{k // 2}", "type": "t", "parameters": str(k)},
                                            "timestamp": "2024-01-01T00:00:00"}) + "　\n")
    return tmpdir_path


def test_a_line_is_decoded_stripped_and_parsed_once(spark, result_files):
    rows = jsonl.read_entity_results(spark, result_files)
    plan = _plan(rows)
    assert plan.count("UrlCodec.decode") == 1 and plan.count("VariantExpressionEvalUtils.parseJson") == 1
    got = rows.select("file", "file_name", "record_id", "latency_ms", "verified").orderBy("load_order").collect()
    names = [f"file={k} x+%" for k in (0, 1, 2)]
    assert [tuple(r) for r in got] == [(0, names[0], "a", 1.0, True), (0, names[0], "b", 2.0, False), (1, names[1], "c", 3.0, True),
                                       (1, names[1], "d", 5.0, None), (2, names[2], "e", 7.0, False)]


def test_file_stats_read_parsed_rows(spark, result_files):
    got = stats.file_stats(jsonl.read_entity_results(spark, result_files))
    assert "from_json" not in _plan(got)
    assert {(r.model, r.model_params, r.file_name, r.total, r.latency_median) for r in got.collect()} == {
        ("m0", "1", "file=1 x+%", 2, 4.0), ("m1", "2", "file=2 x+%", 1, 7.0)}
