"""Result files as one view: order by full path, first and last rows, defaults, catalogue join, batch stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from piisieve import catalogue as cat
from piisieve.operators import consolidate, prompts, replies, scorer, stats
from piisieve.sources import jsonl, sinks
from piisieve.streaming import incremental


def write(folder, name, lines):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join(line if isinstance(line, str) else json.dumps(line) + "\n" for line in lines))
    return path


def record(i, **more):
    return {"recordId": f"r{i}", "input": f"t{i}", **more}


def entity(i, model, latency, verified=True, ts="2024-01-01T00:00:00.000001"):
    return record(i, entityType="E", entityValue="v", timestamp=ts, model={"name": model, "type": "t", "parameters": model + "B"},
                  result={"verified": verified, "confidence": 0.5, "reason": "r", "latencyMs": latency})


def test_inputs_are_told_apart_by_their_full_path(spark, tmpdir_path):
    a = write(tmpdir_path, "b/a/x.jsonl", [record(1)])
    b = write(tmpdir_path, "a/x.jsonl", [record(2)])
    c = write(tmpdir_path, "a/y+1 z.jsonl", [record(3)])
    rows = jsonl.read_jsonl(spark, [a, b, c]).select("recordId", "load_order.file_index").collect()
    assert {r.recordId: r.file_index for r in rows} == {"r1": 0, "r2": 1, "r3": 2}
    back = jsonl.read_jsonl(spark, [c, b, a]).orderBy("load_order").collect()
    assert [r.recordId for r in back] == ["r3", "r2", "r1"]
    globbed = jsonl.read_jsonl(spark, [os.path.join(tmpdir_path, "b/*/*.jsonl"), os.path.join(tmpdir_path, "a/*.jsonl")])
    assert [r.recordId for r in globbed.orderBy("load_order").collect()] == ["r1", "r2", "r3"]
    folder = jsonl.read_jsonl(spark, [b, os.path.join(tmpdir_path, "b/a")])
    assert [r.recordId for r in folder.orderBy("load_order").collect()] == ["r2", "r1"]


def test_last_file_of_a_model_counts(spark, tmpdir_path):
    write(tmpdir_path, "a.jsonl", [entity(1, "m", 1.0), "\n", entity(2, "m", 3.0, False)])
    write(tmpdir_path, "b.jsonl", [entity(1, "n", 7.0), entity(1, "m", 9.0)])       # its first row names the model
    write(tmpdir_path, "c.jsonl", [entity(3, "m", 10.0, False), entity(4, "m", 20.0, ts="2024-01-01T00:00:02.000001")])
    write(tmpdir_path, "d.jsonl", [])
    out = {r.model: r for r in stats.file_stats(jsonl.read_entity_results(spark, tmpdir_path)).collect()}
    assert set(out) == {"m", "n"} and (out["m"].file_name, out["n"].file_name) == ("c", "b")
    assert (out["m"].total, out["m"].verified, out["m"].latency_p50, out["m"].total_time_sec) == (2, 1, 15.0, 2.0)
    assert (out["n"].total, out["n"].model_params) == (2, "nB")


def test_no_result_files(spark, tmpdir_path):
    assert stats.file_stats(jsonl.read_entity_results(spark, tmpdir_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        jsonl.read_entity_results(spark, os.path.join(tmpdir_path, "none"))


def test_missing_keys_take_defaults_and_nulls_stay(spark, tmpdir_path):
    items = [{}, {"pii": None, "verified": None, "reason": None}, {"pii": "A", "verified": True}, "stray", 5, {"pii": "B", "reason": "x"}]
    path = write(tmpdir_path, "m.jsonl", [record(1, verified_piis=items)])
    long = consolidate.results_long(jsonl.read_results(spark, path), model_col="model_tag", fill_nulls=False).orderBy("item_pos").collect()
    assert [(r.pii, r.verified, r.reason) for r in long] == [
        ("", False, cat.CONSOLIDATE_NO_REASON), (None, False, None), ("A", True, cat.CONSOLIDATE_NO_REASON), ("B", False, "x")]


def test_comparison_file_header(spark, tmpdir_path):
    path = write(tmpdir_path, "m.jsonl", [record(1, verified_piis=[{"pii": "A", "verified": True, "reason": "a,\n\"b\""}])])
    wide = consolidate.consolidate(consolidate.results_long(jsonl.read_results(spark, path), model_col="model_tag"), ["m"])
    out = os.path.join(tmpdir_path, "csv")
    sinks.write_comparison_csv(wide, out, single_file=True, report_header=True)
    part = next(f for f in os.listdir(out) if f.startswith("part"))
    assert open(os.path.join(out, part)).readline().strip() == "Input Text,PII,m_Verified,m_Reason"
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out).first()
    assert tuple(back) == ("t1", "A", "YES", "a,\n\"b\"")


@pytest.mark.parametrize("bound", [0, 100_000])
def test_catalogue_of_a_million_rows(spark, bound):
    big = spark.range(1_000_000).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("name"),
                                        F.concat(F.lit("text "), F.col("id").cast("string")).alias("description"))
    rows = [("1", "x", ["L5", "nope", "L999999", "L5"]), ("2", "y", []), ("3", "z", None), ("3", "z2", ["L7"])]
    df = spark.createDataFrame(rows, "recordId string, input string, PIIs array<string>")
    got = {r.input: r.element_descriptions for r in prompts.with_descriptions(df, big, broadcast_rows=bound).collect()}
    assert got == {"x": f"- **L5**: text 5\n- **nope**: {cat.NO_DESCRIPTION}\n- **L999999**: text 999999\n- **L5**: text 5",
                   "y": cat.NO_PIIS, "z": None, "z2": "- **L7**: text 7"}


def test_prompts_from_a_catalogue_table_equal_the_built_in(spark):
    rows = [("1", "x", ["Email Address", "nope"]), ("2", "y", []), ("3", "z", ["Salary"])]
    df = spark.createDataFrame(rows, "recordId string, input string, PIIs array<string>")
    table = spark.createDataFrame([(n, d) for n, _, d in cat.LABEL_CATALOGUE], "name string, description string")
    own = sorted(map(tuple, prompts.prompt_table(df).collect()))
    assert sorted(map(tuple, prompts.prompt_table(df, catalogue=table).collect())) == own and len(own) == 4


@pytest.mark.parametrize("mode", ["simple", "reasoning"])
def test_batch_stream_equals_its_batch_twin(spark, tmpdir_path, mode):
    src = os.path.join(tmpdir_path, "in")
    good = [{**record(i, PIIs=["Email Address", "Salary"][:i % 3]), "input": "my email"} for i in range(9)]
    write(src, "a.jsonl", good[:5] + ["{bad\n", "\n", '{"recordId": "q"}, {"recordId": "p"}\n', json.dumps({"recordId": "x", "input": "y"}) + "\n"])
    write(src, "b.jsonl", good[5:])
    out, dead, ck = (os.path.join(tmpdir_path, d) for d in ("out", "dead", "ck"))
    for _ in range(2):            # the second run finds nothing new
        incremental.start_batch_verification(spark, src, out, dead, ck, scorer.KeywordScorer, "echo", mode).awaitTermination()
    records = spark.createDataFrame([(r["recordId"], r["input"], r["PIIs"]) for r in good], jsonl.DETECTED_RECORD)
    want = replies.verify_records(records, scorer.KeywordScorer, "echo", mode)
    cols = [c for c in want.columns if c != "latency_ms"]
    got = spark.read.schema(want.schema).json(out)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert {r.recordId for r in got.where("latency_ms = 0 AND size(verified_piis) = 0").collect()} >= {"r0", "r3", "r6"}
    assert sorted(r.reject_reason for r in spark.read.json(dead).collect()) == ["invalid_json", "invalid_json", "missing_PIIs"]


def test_entity_stream_takes_one_value_a_line(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    line = '{"recordId": "1", "input": "a.b@gmail.com", "entityType": "EMAIL", "entityValue": "a.b@gmail.com"}'
    write(src, "a.jsonl", [line + "\n", line.replace('"1"', '"2"') + ", " + line + "\n"])
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    incremental.start_append(incremental.verify_entity_stream(spark, src), out, ck).awaitTermination()
    assert [r.recordId for r in spark.read.json(out).collect()] == ["1"]
