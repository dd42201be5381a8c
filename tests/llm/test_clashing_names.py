"""Operators and stages that return their input's columns accept any further names, those they add themselves too."""

import pytest

from piisieve.llm import decontaminate, lines, quality, simhash

OWN = ["_n_words", "_spans", "_items", "_longest", "_clean", "_p", "_kept", "_base_failed", "_c0", "_c1", "_text", "_key",
       "_gone", "_file", "_row", "_own", "fp", "root", "line", "n_words", "key", "label"]
PASSAGE = " ".join(f"w{i}" for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(50)) + f"\nshared\n{PASSAGE if i == 2 else ''}", f"s{i}", *OWN) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in OWN))


@pytest.mark.parametrize("stage", ["quality", "lines", "simhash", "benchmark"])
def test_stages_keep_clashing_columns(spark, docs, stage):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    out = {"quality": lambda: quality.kept_documents(docs, labels.where("false")), "lines": lambda: lines.deduplicated(docs),
           "simhash": lambda: simhash.deduplicated(docs), "benchmark": lambda: decontaminate.decontaminated(docs, bench)}[stage]()
    rows = out.collect()
    assert out.columns == docs.columns and rows
    assert all(r[c] == c for r in rows for c in OWN)
    if stage == "lines":
        assert sum("\nshared\n" in r.text for r in rows) == 1
    if stage == "benchmark":
        assert len(rows) == 11 + 1 and not any("w3 w4" in r.text for r in rows)
