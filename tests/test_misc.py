"""Small operators without a table-driven query: B-02, B-06, C-12, E-17, G-01, G-07, I-23, I-26."""

import datetime as dt
import os

from pyspark.sql import functions as F

from piisieve.operators import consolidate as C
from piisieve.operators import decisions, stats
from piisieve.sources import sinks


def test_dead_letters_and_run_partitions(spark, tmpdir_path):
    df = spark.createDataFrame([("a", None), ("b", "invalid_json")], "recordId string, reject_reason string")
    good, bad = os.path.join(tmpdir_path, "good"), os.path.join(tmpdir_path, "dead")
    sinks.write_with_dead_letters(df, good, bad)
    assert [r.recordId for r in spark.read.json(good).collect()] == ["a"]
    assert [r.recordId for r in spark.read.json(bad).collect()] == ["b"]
    ts = spark.createDataFrame([(dt.datetime(2024, 5, 6, 7, 8, 9),)], "t timestamp")
    stamp = ts.select(sinks.run_stamp(F.col("t")).alias("s")).first().s
    assert stamp == "20240506_070809"
    runs = os.path.join(tmpdir_path, "runs")
    sinks.write_partitioned(df.withColumn("run_id", F.lit(stamp)), runs, ["run_id"])
    assert os.path.isdir(os.path.join(runs, f"run_id={stamp}"))


def test_lookup_first_and_model_order(spark):
    df = spark.createDataFrame([("r2", "x"), ("r1", "y"), ("r3", "y")], "recordId string, input string")
    assert C.lookup_record(df, "r3").count() == 1
    assert C.first_record(df, F.col("input") == "y").first().recordId == "r1"
    lg = spark.createDataFrame([("b", 2), ("a", 5), ("b", 1)], "model string, load_order long")
    assert [r.model for r in C.model_order(lg).collect()] == ["b", "a"]


def test_comparison_table_and_argmax(spark):
    s = spark.createDataFrame([("m2", 5.0), ("m1", 5.0), ("m0", 9.0)], "model string, latency_p95 double")
    assert [r.model for r in stats.comparison_table(s).collect()] == ["m1", "m2", "m0"]
    a = spark.createDataFrame([([0.1, 0.7, 0.7, 0.2],)], "a array<double>")
    assert a.select(decisions.argmax(F.col("a")).alias("i")).first().i == 1


def test_spread_only_touches_small_inputs(spark):
    from piisieve.session import spread
    big = spark.range(0, 1000, numPartitions=16)
    assert spread(big, 8) is big                       # already parallel: left untouched
    small = spark.range(0, 1000, numPartitions=1)
    assert spread(small, 8).rdd.getNumPartitions() == 8
