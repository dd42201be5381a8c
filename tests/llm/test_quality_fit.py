"""The classifier's optimiser against a closed form, and its training against plain gradient descent in numpy."""

import numpy as np
import pytest

from piisieve.llm import quality


def test_minimised_finds_a_quadratic_minimum():
    rng = np.random.default_rng(3)
    root = rng.normal(size=(12, 12))
    curve, shift = root @ root.T + np.eye(12), rng.normal(size=12)
    calls = []

    def evaluate(w):
        calls.append(w)
        return 0.5 * w @ curve @ w - shift @ w, curve @ w - shift, len(calls)
    w, rest = quality.minimised(evaluate, 12, passes=60, memory=12)
    assert np.allclose(w, np.linalg.solve(curve, shift), atol=1e-3) and len(calls) == 60 and rest <= 60


@pytest.fixture(scope="module")
def sample(spark):
    rng, rows = np.random.default_rng(9), []
    for key in range(80):
        label = int(key % 3 > 0)
        own = np.unique(np.append(rng.integers(0, 400, 25), rng.integers(0, 20, 4) + 500 * label))
        rows.append((key - 40, label, own.astype(np.int32).tobytes(), np.full(len(own), 1 / len(own), np.float32).tobytes()))
    return rows, spark.createDataFrame(rows, "key bigint, label int, slots binary, vals binary").repartition(5)


def test_fit_equals_plain_descent(sample):
    rows, df = sample
    weights, slope, offset = quality._fit(df)
    y = np.array([r[1] for r in rows], float)
    x = np.zeros((len(rows), quality.DIMS + 1))
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r[2], np.int32)] = np.frombuffer(r[3], np.float32) * 30
    x[:, -1] = 1
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    fit = np.arange(len(y)) % 5 != 4
    share = np.where(y == 1, 0.5 / (y[fit] == 1).sum(), 0.5 / (y[fit] == 0).sum()) * fit
    decay = np.where(used == quality.DIMS, 0.0, quality.DECAY)

    def loss(w):
        z = x @ w
        return (share * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (decay * w * w).sum()
    w = np.zeros(len(used))
    for _ in range(20000):
        w -= 0.1 * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) + decay * w)
    got = weights[used] / np.where(used == quality.DIMS, 1, 30)
    assert loss(got) < loss(w) * 1.05 and loss(np.zeros(len(used))) > 3 * loss(w)
    z = x @ got
    assert (z[y == 1].min() > z[y == 0].max()) and slope > 0 and np.isfinite(offset)
    assert not weights[np.setdiff1d(np.arange(quality.DIMS), used)].any()


def test_one_class_gives_no_model(sample):
    weights, slope, offset = quality._fit(sample[1].where("label = 1"))
    assert len(weights) == 0 and slope == offset == 0.0
