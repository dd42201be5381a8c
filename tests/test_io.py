"""Sources and sinks (FIXTURES §6.1, B-01 ... B-07)."""

import os

import pytest

from piisieve.sources import jsonl, sinks

LINES = [
    '{"recordId": "a", "input": "x", "PIIs": ["Email Address"]}',
    "   ",
    "{bad",
    '{"input": "no id"}',
    '{"recordId": "b"}',
    '{"other": 1}',
    '{"recordId": null, "input": "null id kept", "PIIs": []}',
    '{"recordId": "c", "input": "y"} trailing',
]


def _write(d, name, lines):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_tolerant_reader(spark, tmpdir_path):
    p = _write(tmpdir_path, "a_reasoning.v2.jsonl", LINES)
    kept = jsonl.read_jsonl(spark, p).collect()
    assert sorted(r.input for r in kept) == ["null id kept", "x"]
    assert {r.model_tag for r in kept} == {"a_reasoning.v2"}
    rej = {r.raw_line: r.reject_reason for r in jsonl.read_jsonl(spark, p, rejects=True).collect()}
    assert rej["{bad"] == "invalid_json"
    assert rej['{"input": "no id"}'] == "missing_recordId"
    assert rej['{"recordId": "b"}'] == "missing_input"
    assert rej['{"other": 1}'] == "missing_recordId"
    assert rej['{"recordId": "c", "input": "y"} trailing'] == "invalid_json"
    assert jsonl.count_nonblank(spark, p) == 7


def test_load_order_follows_lines(spark, tmpdir_path):
    lines = [f'{{"recordId": "r{i}", "input": "t"}}' for i in range(50)]
    p = _write(tmpdir_path, "m.jsonl", lines)
    rows = jsonl.read_jsonl(spark, p).orderBy("load_order").collect()
    assert [r.recordId for r in rows] == [f"r{i}" for i in range(50)]


def test_missing_paths(spark, tmpdir_path):
    p = _write(tmpdir_path, "ok.jsonl", LINES[:1])
    df = jsonl.read_jsonl(spark, [p, os.path.join(tmpdir_path, "nope.jsonl")], ignore_missing=True)
    assert df.count() == 1
    with pytest.raises(FileNotFoundError):
        jsonl.read_jsonl(spark, [os.path.join(tmpdir_path, "nope.jsonl")], ignore_missing=True)
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, os.path.join(tmpdir_path, "nope.jsonl")).count()


def test_strict_reader_fails_fast(spark, tmpdir_path):
    p = _write(tmpdir_path, "bad.jsonl", LINES[:1] + ["{bad"])
    with pytest.raises(Exception):
        jsonl.read_jsonl_strict(spark, p, jsonl.DETECTED_RECORD).collect()


def test_results_dir(spark, tmpdir_path):
    _write(tmpdir_path, "m1.jsonl", LINES[:1])
    open(os.path.join(tmpdir_path, "empty.jsonl"), "w").close()
    df = jsonl.read_results_dir(spark, tmpdir_path, jsonl.DETECTED_RECORD)
    assert df.count() == 1
    with pytest.raises(FileNotFoundError):
        jsonl.read_results_dir(spark, os.path.join(tmpdir_path, "missing"), jsonl.DETECTED_RECORD)


def test_catalogue(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "elements.json")
    with open(p, "w") as f:
        f.write('[{"name": "A", "description": "old", "category": "c"},\n'
                ' {"name": "A", "description": "new", "category": "c"},\n'
                ' {"name": "B", "description": "", "category": "c"},\n'
                ' {"name": "", "description": "x", "category": "c"}]')
    rows = {r.name: r.description for r in jsonl.read_catalogue(spark, p).collect()}
    assert rows == {"A": "new"}
    assert jsonl.read_catalogue(spark, os.path.join(tmpdir_path, "none.json")).count() == 0


def test_csv_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("r1", 'say "hi", then\nleave')], "a string, b string")
    out = os.path.join(tmpdir_path, "csv")
    sinks.write_comparison_csv(df, out, single_file=True)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    assert back.first().b == 'say "hi", then\nleave'


def test_dynamic_partition_overwrite(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "res")
    first = spark.createDataFrame([("r", "simple", "m1"), ("r", "reasoning", "m1")], "recordId string, mode string, model string")
    sinks.write_partitioned(first, out, ["mode", "model"])
    again = spark.createDataFrame([("r2", "reasoning", "m1")], "recordId string, mode string, model string")
    sinks.write_partitioned(again, out, ["mode", "model"])
    got = {(r.mode, r.recordId) for r in spark.read.json(out).collect()}
    assert got == {("simple", "r"), ("reasoning", "r2")}


def test_jsonl_sink_keeps_nulls(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "j")
    sinks.write_jsonl(spark.createDataFrame([("a", None)], "x string, y string"), out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".json"))
    assert '"y":null' in text


def test_entity_results_shape(spark):
    df = spark.createDataFrame([("r", "t", None, None, True, 0.123456, "ok")],
                               "recordId string, input string, entityType string, entityValue string, "
                               "verified boolean, confidence double, reason string")
    r = sinks.entity_results(df, "rules", "cpu", "0").first()
    assert r.entityType == "UNKNOWN" and r.entityValue == "" and r.metadata == {}
    assert r.result.confidence == 0.1235 and r.model.name == "rules" and r.timestamp.endswith("Z")


def test_result_items_read_one_by_one(spark, tmpdir_path):
    from piisieve.operators import consolidate as C
    p = _write(tmpdir_path, "m_reasoning.jsonl", [
        '{"recordId": "a", "input": "t", "verified_piis": ["Email Address"], "model": "m"}',
        '{"recordId": "b", "input": "u", "verified_piis": [{"pii": "Phone Number", "verified": true, '
        '"reason": "r"}, "stray", {"pii": "Salary"}], "model": "m"}',
        '{"recordId": "c", "input": "v", "verified_piis": "oops", "model": "m"}'])
    df = jsonl.read_results(spark, [p])
    assert df.count() == 3
    long = {(r.record_id, r.pii): (r.verified, r.reason)
            for r in C.results_long(df, model_col="model_tag").collect()}
    assert long == {("b", "Phone Number"): (True, "r"), ("b", "Salary"): (False, "No reason provided")}
