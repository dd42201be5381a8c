"""Each corpus operator on small tables: nulls, empty texts, ties, repeated rows, extra columns, no rows."""

import zlib

import numpy as np
import pytest

from piisieve.llm import decontaminate, lines, packing, ppm, quality, secrets, simhash, substrings, token_orc, urls

PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, PASSAGE + " tail one", "a", "x"), (2, "head " + PASSAGE, "b", "x"), (3, None, None, None), (4, "", "a", "x"),
        (None, "short text", "a", "x"), (5, "Only here, a plain text of few words", "a", "x"),
        (5, "Only here, a plain text of few words", "a", "x"), (6, "\n".join(["The same long boilerplate line"] * 2), "a", "x")]
SCHEMA = "doc_id bigint, text string, source string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(7, PASSAGE), (8, "few words"), (9, None), (None, "short text")], "item_id bigint, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.report(docs, bench).collect()}
    assert (rows[1, 62].n_hit, rows[2, 61].n_hit, rows[3, 0].n_hit) == (60, 60, 0)
    assert rows[5, 8].n_hit == 2 and rows[5, 8].n_items == 1
    assert rows[None, 2].n_hit == 2 and rows[None, 2].n_items == 0
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6}
    assert decontaminate.report(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.where("false")).collect())


def test_substrings(docs, none):
    rows = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.report(docs).collect())
    assert rows == sorted([(1, 62, 60), (2, 61, 60), (3, 0, 0), (4, 0, 0), (0, 2, 0), (5, 8, 0), (5, 8, 0), (6, 10, 0)])
    assert substrings.report(none).count() == 0


def test_simhash(spark, docs, none):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.report(docs).collect()}
    assert rows[3, "0" * 16] == rows[4, "0" * 16] == 3
    assert simhash.report(none).count() == 0
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert kept.count(5) == 1 and kept.count(3) == 1 and 4 not in kept


def test_links_find_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base for k in (0, 1, 2, 3, 4, 5)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint")
    root = {r.fp: r.root for r in simhash.groups(df).collect()}
    assert {tuple(r) for r in simhash.links(df, dense=0).collect()} == {tuple(r) for r in simhash.links(df).collect()}
    want = {x: x for x in fps}
    for _ in fps:
        for x in fps:
            want[x] = min(want[y] for y in fps if (x ^ y).bit_count() <= 3)
    parts = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    assert parts({x: root[simhash._signed(x)] for x in fps}) == parts(want)


def test_lines(spark, docs, none):
    many = spark.createDataFrame([(i, f"own {i}\nThe same long boilerplate line", f"s{i % 12}", "x") for i in range(24)], SCHEMA)
    rows = {r.doc_id: r.n_removed for r in lines.report(many).collect()}
    assert rows[0] == 0 and all(rows[i] == 1 for i in range(1, 24))
    assert lines.deduplicated(docs).columns == docs.columns and lines.report(docs).count() == len(ROWS)
    assert lines.report(none).count() == 0


def test_packing_and_tokens(docs, none):
    pieces = packing.report(docs).collect()
    assert sorted(p.offset for p in pieces)[0] == 0 and sum(p.length for p in pieces if p.doc_id == 4) == 1
    assert packing.report(none).count() == 0 and token_orc.report(none).count() == 0
    rows = sorted(token_orc.report(docs).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.ids_crc32 for r in rows if r.doc_id == 4] == [zlib.crc32(np.array([2], "<u4").tobytes())]


def test_hilbert_neighbours_touch():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_key(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.report(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality.report(none, labels).count() == 0
    assert {r.kept for r in quality.report(docs, labels.where("false")).collect() if r.n_words > 20} == {True}


def test_ppm(docs, none):
    rows = ppm.scored(docs, hot=16).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 for r in rows) and ppm.scored(none).count() == 0


def test_secrets(spark, none):
    df = spark.createDataFrame([(1, "é token = \"abc123\" x"), (2, None), (3, "secret=ab:cdefgh")], "doc_id bigint, text string")
    rows = {r.doc_id: r.spans for r in secrets.report(df).collect()}
    assert rows == {1: "assign:2:17", 2: "", 3: ""} and secrets.report(none).count() == 0


def test_urls(spark):
    pages = [(1, "http://A.net/x", None), (2, "http://good.org/fr/1", '<a href="http://b.com/">'), (3, "http://b.com/en/", None),
             (4, "http://bad.com/", '<a href="https://a.net/q">'), (5, None, None), (6, "http://example.net/en/", "")]
    rows = {r.page_id: (r.host, r.rule, r.verdict) for r in
            urls.report(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert rows[1] == ("a.net", "net/", "block") and rows[2] == ("good.org", "org/fr/", "allow")
    assert rows[3][2] == "allow" and rows[4][2] == "block" and rows[5] == ("", None, "allow")
    assert rows[6] == ("example.net", "example.net/en/", "allow")
