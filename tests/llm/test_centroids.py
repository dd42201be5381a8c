"""Centroid clustering against plain Python, the search against all distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from piisieve.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, distance int, q int, id int"


def plain(rows, k=16, rounds=3, dims=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * x) for x in v]))
    seed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in seed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(middle)):
            some = [v for (_, v), o in zip(kept, own) if o == j]
            if some:
                middle[j] = [sum(c) // len(some) for c in zip(*some)]
    out = [(vec_id, *reversed(nearest(v))) for vec_id, v in kept]
    whole = sum(d for *_, d in out)
    return [(i, j, d, sum(x for _, o, x in out if o == j), whole,
             hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, j, d in out]


def got(df):
    return sorted(map(tuple, centroids.report(df).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 5, 120])
def test_same_as_plain(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(n)]
    if rows:
        rows += rows[:3] + [(100 + i, rows[0][1]) for i in range(40)] + [(None, rows[0][1])]
    rows += [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [None] + [0.5] * 63),
             (6, [float("nan")] * 64), (7, [float("inf")] + [0.0] * 63)]
    assert got(frame(spark, rows)) == sorted(plain(rows), key=str)


def test_hot_vector_and_ties(spark):
    """A third of the rows are one vector; all vectors lie on two points, so that centroids tie."""
    a, b = [0.25] * 64, [-0.25] * 64
    rows = [(i, a if i % 3 else b) for i in range(90)]
    assert got(frame(spark, rows).repartition(7)) == sorted(plain(rows), key=str)


def test_floats_and_huge_components(spark):
    df = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.1] * 64)], "vec_id int, embedding array<double>")
    rows = {r.vec_id: r for r in centroids.report(df).collect()}
    assert len(rows) == 3 and all(r.distance == 0 for r in rows.values())
    single = spark.createDataFrame([(1, [0.1] * 64)], "vec_id int, embedding array<float>")
    assert centroids.integer_vectors(single, "vec_id", "embedding").first().q == [math.floor(64 * float(np.float32(0.1)))] * 64


@pytest.mark.parametrize("scale,k", [(20, 1), (20, 16), (1 << 24, 16), (1, 40)])
def test_search_finds_the_nearest(scale, k):
    rng = np.random.default_rng(k)
    x = np.clip(np.floor(rng.normal(size=(500, 64)) * scale), -(1 << 25), 1 << 25).astype(np.int64)
    c = x[rng.integers(0, 500, k)].copy()
    c[k // 2] = c[0]
    found, distance = centroids.Search(c).nearest(x)
    every = np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)
    assert (every.argmin(axis=1) == found).all() and (every.min(axis=1) == distance).all()


def test_search_rejects_far_centroids():
    rng = np.random.default_rng(1)
    c = np.arange(16)[:, None] * 1000 + rng.integers(0, 20, (16, 64))
    x = np.repeat(c, 50, axis=0) + rng.integers(0, 20, (800, 64))
    search = centroids.Search(c)
    search.nearest(x)
    assert search.measured < 2 * len(x)


def test_other_names_and_sizes(spark):
    df = spark.range(40).select(F.col("id").alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    rows, middle = centroids.clustered(df, "key", "vec", k=3, rounds=2, dims=2)
    assert rows.columns == ["key", "cluster", "distance"] and middle.shape == (3, 2) and rows.count() == 40
