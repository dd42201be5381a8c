"""Exactly one JSON value, Python's white space, load order of inputs, scorers of one name."""

import json
import os

from pyspark.sql import functions as F

from piisieve.functions.text import py_strip, word_set
from piisieve.operators import scorer
from piisieve.operators.replies import strict_json
from piisieve.sources import jsonl


def test_two_values_are_not_one(spark):
    rows = [('{"a":1}', True), ('{"a":1}, {"b":2}', False), ('{"a":1} {"b":2}', False), ("1", True), ("1,2", False), ("", False)]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string")
    assert [r[0] for r in df.select(strict_json(F.col("s")).isNotNull()).collect()] == [ok for _, ok in rows]


def test_python_white_space(spark):
    texts = [" ", "　a ", " Email Address ", "\x1cx\x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(py_strip("s"), word_set("s")).collect()
    assert [(r[0], list(r[1])) for r in got] == [(t.strip(), t.split()) for t in texts]


def test_load_order_follows_the_paths(spark, tmpdir_path):
    paths = []
    for i, name in enumerate(["b/same.jsonl", "a/same.jsonl", "folder"]):
        path = os.path.join(tmpdir_path, name)
        target = os.path.join(path, "part.jsonl") if name == "folder" else path
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w") as f:
            f.write(json.dumps({"recordId": str(i), "input": "x"}) + "\n")
        paths.append(path)
    rows = jsonl.read_jsonl(spark, paths).orderBy("load_order").collect()
    assert [r["recordId"] for r in rows] == ["0", "1", "2"]


def test_scorers_of_one_name_stay_apart(spark):
    def make(word):
        class One(scorer.Scorer):
            def score(self, batch):
                return [word] * len(batch)
        return lambda: One()
    df = spark.createDataFrame([(1,)], "id int")
    assert [scorer.score_with(df, make(w)).first()["raw_response"] for w in ("x", "y")] == ["x", "y"]
