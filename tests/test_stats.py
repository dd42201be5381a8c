"""Statistics, rankings and ordering helpers (FIXTURES §6.6)."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from piisieve.operators import stats

SCHEMA = "model string, record_id long, latency_ms double, confidence double, verified boolean, ts timestamp_ntz"


def _log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_even_count_median_and_percentiles(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("m", i, float(i), 0.5, i % 2 == 0, t + dt.timedelta(seconds=i)) for i in range(1, 5)]
    s = stats.model_stats(_log(spark, rows)).first()
    assert s.latency_median == 2.5 and abs(s.latency_p95 - 3.85) < 1e-12 and abs(s.latency_p99 - 3.97) < 1e-12
    assert (s.total, s.verified, s.rejected) == (4, 2, 2)
    assert s.total_time_sec == 3.0 and abs(s.items_per_sec - 4 / 3) < 1e-12


def test_empty_run_is_all_zero(spark):
    s = stats.overall_stats(_log(spark, [])).collect()
    assert len(s) == 1 and s[0].total == 0 and s[0].latency_p95 == 0 and s[0].verification_rate == 0


def test_best_performers_tie_breaks_by_name(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("b", 1, 10.0, 0.9, True, t), ("a", 2, 10.0, 0.8, False, t)]
    b = stats.best_performers(stats.model_stats(_log(spark, rows))).first()
    assert b.fastest_model == "a" and b.most_confident_model == "b" and b.most_selective_model == "a"


def test_later_file_replaces_model(spark):
    df = spark.createDataFrame([("m", 1, 1), ("m", 2, 2), ("m", 3, 2), ("n", 4, 1)],
                               "model string, record_id long, file_order int")
    kept = sorted(r.record_id for r in stats.keep_latest_file(df).collect())
    assert kept == [2, 3, 4]


def test_sequence_number_matches_row_number(spark):
    df = spark.range(0, 5000).select(
        (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7 % 1000).alias("k"), F.col("id"))
    got = stats.sequence_number(df, ["g"], ["k", "id"], num_partitions=7)
    w = Window.partitionBy("g").orderBy("k", "id")
    want = df.withColumn("seq", F.row_number().over(w))
    assert got.select("id", "seq").exceptAll(want.select("id", "seq")).count() == 0
    assert got.count() == 5000


def test_batches_short_last_batch(spark):
    df = spark.range(0, 10).select(F.lit("m").alias("model"), F.col("id"), F.lit(2.0).alias("latency_ms"))
    b = stats.batch_latency(stats.assign_batches(df, 4, ["model"], ["id"]), ["model"])
    sizes = sorted((r.batch_id, r.batch_size, r.per_item_ms) for r in b.collect())
    assert sizes == [(0, 4, 2.0), (1, 4, 2.0), (2, 2, 2.0)]


def test_error_count_first_info_and_summary(spark):
    df = spark.createDataFrame(
        [("f1", 2, "m1", "cpu", "66M", 1.0, 0.5, True, dt.datetime(2024, 1, 1), None),
         ("f1", 1, "m0", "gpu", "1B", 2.0, 0.7, False, dt.datetime(2024, 1, 1, 0, 0, 1), "P-08")],
        "model_tag string, load_order long, name string, type string, parameters string, latency_ms double, "
        "confidence double, verified boolean, ts timestamp_ntz, parse_path string")
    info = stats.first_model_info(df).first()
    assert (info.name, info.type, info.parameters) == ("m0", "gpu", "1B")
    s = stats.model_stats(df.withColumnRenamed("model_tag", "model"), error_col="parse_path")
    row = s.first()
    assert row.error_count == 1
    lines = stats.summary_lines(s).first()
    assert lines.verified_line == "Verified: 1 (50.0%)" and lines.total_line == "Total Processed: 2"


def test_approx_percentiles(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("m", i, float(i), 0.5, True, t) for i in range(1, 101)]
    s = stats.model_stats(_log(spark, rows), approx=True).first()
    assert 94 <= s.latency_p95 <= 96


def test_hot_group_spans_many_tasks(spark):
    # one model holds a third of all rows; its numbering must not sit in a single partition
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.col("id"))
    got = stats.sequence_number(df, ["g"], ["id"], num_partitions=12)
    parts = (got.filter(F.col("g") == "hot").select(F.spark_partition_id().alias("p"))
             .distinct().count())
    assert parts >= 3
    hot = got.filter(F.col("g") == "hot").agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    assert tuple(hot) == (1, 10000, 10000)
