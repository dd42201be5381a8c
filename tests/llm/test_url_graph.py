"""Trust and distrust on planted link graphs against power iteration, and verdicts under more seeds."""

import numpy as np
import pytest

from piisieve.llm import urls

RULES = [("block", "bad", "/"), ("allow", "good", "/")]
LINKS = {"a.good": ["x1", "x1", "x2"], "x1": ["x2", "x3", "x1"], "x2": ["x4"], "x3": ["s.bad", "x4"], "x4": ["s.bad", "s.bad", "x5"],
         "x5": ["s.bad"], "x6": ["x5", "x6"], "s.bad": ["x7"], "x7": []}


def _pages(spark, extra=0):
    rows = [(i, f"http://{host}/p", "".join(f'<a href="https://{to}/q">' for to in out)) for i, (host, out) in enumerate(LINKS.items())]
    rows += [(1000 + i, f"http://z{i}.bad/", None) for i in range(extra)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def _iterated(share, seed):
    rank = np.zeros(len(seed))
    for _ in range(500):
        rank = (1 - urls.DAMPING) * seed + urls.DAMPING * rank @ share
    return rank


@pytest.fixture(scope="module")
def judged(spark):
    return {r.host: r for r in urls.judged(_pages(spark), RULES).collect()}


def test_ranks_equal_power_iteration(judged):
    hosts = sorted(LINKS)
    share = np.zeros((len(hosts), len(hosts)))
    for src, out in LINKS.items():
        for dst in out:
            share[hosts.index(src), hosts.index(dst)] += src != dst
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1)
    back = share.T / np.where(share.sum(axis=0) > 0, share.sum(axis=0), 1)[:, None]
    trust = _iterated(share, np.array([h.endswith("good") for h in hosts], float))
    distrust = _iterated(back, np.array([h.endswith("bad") for h in hosts], float))
    for i, host in enumerate(hosts):
        assert judged[host].trust == pytest.approx(trust[i], abs=1e-3)
        assert judged[host].distrust == pytest.approx(distrust[i], abs=1e-3)
    assert [h for h in hosts if judged[h].verdict == "block"] == [
        h for h in hosts if h.endswith("bad") or (not h.endswith("good") and distrust[hosts.index(h)] > trust[hosts.index(h)])]
    assert judged["x5"].verdict == "block" and judged["x1"].verdict == "allow"


def test_other_seeds_do_not_change_a_verdict(spark, judged):
    more = {r.host: r for r in urls.judged(_pages(spark, 200), RULES).collect()}
    for host in LINKS:
        assert more[host].verdict == judged[host].verdict
        assert more[host].distrust == pytest.approx(judged[host].distrust, abs=1e-3)
