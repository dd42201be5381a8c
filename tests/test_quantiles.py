"""Exact quantiles and sequence numbers at skewed groups and values; sketches within their bound."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from piisieve.operators import quantiles, stats


def rows(seed=1, n=6000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 10 else rng.choice(["a", "b", None])             # one group holds 90 % of the rows
        v = rng.choice([rng.lognormvariate(3, 2), -rng.random() * 1e6, round(rng.random(), 1), 0.0, 1e300 * rng.random(), None])
        out.append((g, v, rng.choice([None, 0.25, 0.5])))
    return out + [("alone", 7.0, None), ("none", None, None)]


def test_same_as_numpy(spark):
    data = rows()
    probs = [0.0, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame(data, "g string, v double, c double").repartition(5)
    got = {r.g: (r.v_q, r.c_q) for r in quantiles.exact_quantiles(df, ["g"], {"v": probs, "c": [0.5]}).collect()}
    for g in {d[0] for d in data}:
        for j, (ps, col) in enumerate(((probs, 1), ([0.5], 2))):
            own = [d[col] for d in data if d[0] == g and d[col] is not None]
            if not own:
                assert got.get(g) is None or got[g][j] is None
            else:
                assert got[g][j] == pytest.approx(list(np.quantile(own, ps)), rel=1e-12)
    whole = quantiles.exact_quantiles(df, [], {"v": probs}).first().v_q
    assert whole == pytest.approx(list(np.quantile([d[1] for d in data if d[1] is not None], probs)), rel=1e-12)
    assert quantiles.exact_quantiles(df.where("false"), ["g"], {"v": probs}).count() == 0


def test_same_as_the_built_in_percentile(spark):
    df = spark.range(0, 20000).select((F.col("id") % 7).alias("g"), F.round(F.exp(F.randn(3) * 2), 2).alias("v"))
    want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q"))
    got = quantiles.exact_quantiles(df, ["g"], {"v": [0.5, 0.95, 0.99]})
    both = {r.g: r.q for r in want.collect()}
    for r in got.collect():
        assert r.v_q == pytest.approx(both[r.g], rel=1e-12)


def test_no_map_of_a_groups_values_in_the_plans(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 0.5, True, dt.datetime(2024, 1, 1))],
                               "model string, record_id long, latency_ms double, confidence double, verified boolean, ts timestamp_ntz")
    for out in (stats.model_stats(df), stats.windowed_stats(df), stats.overall_stats(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan and "collect_set" not in plan


def test_null_times_are_zero_seconds(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 0.5, True, None)],
                               "model string, record_id long, latency_ms double, confidence double, verified boolean, ts timestamp_ntz")
    s = stats.model_stats(df).first()
    assert s.total_time_sec == 0.0 and s.items_per_sec == 0.0


def test_sketch_within_its_bound(spark):
    data = [(g, v, c) for g, v, c in rows(2, 20000) if v is None or abs(v) < 1e9]
    df = spark.createDataFrame(data, "g string, v double, c double").repartition(9)
    out = quantiles.sketch_check(df, "g", "v", [0.01, 0.5, 0.95, 0.99], 200).collect()
    assert len(out) == 20 and all(r.within_bound for r in out)
    assert all(r.rank_error == quantiles.rank_error(200) < 0.04 for r in out)


@pytest.mark.parametrize("order", [["t", "id"], ["d", "id"], ["x", "id"], ["s", "id"]])
def test_sequence_numbers_of_a_hot_group(spark, order):
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        t = base + dt.timedelta(seconds=rng.choice([0, rng.randrange(100), rng.randrange(10 ** 8)]))
        data.append((None if i % 30 == 0 else "hot" if i % 10 else "g", i, rng.choice([t, t, None]), t.date(),
                     rng.choice([rng.expovariate(1), 1e200, None]), str(rng.random())))
    df = spark.createDataFrame(data, "g string, id long, t timestamp_ntz, d date, x double, s string").repartition(6)
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    got = stats.sequence_number(df, ["g"], order)
    assert got.columns == [*df.columns, "seq"]
    assert sorted(got.select("id", "seq").collect()) == sorted(want.select("id", "seq").collect())


def test_numbering_runs_nothing_before_the_query(spark):
    df = spark.range(0, 5000).select((F.col("id") % 2).alias("g"), "id")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    out = stats.assign_batches(df, 32, ["g"], ["id"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert "Scan ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
