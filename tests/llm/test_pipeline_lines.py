"""The pipeline's line dedup finds boilerplate of any length and script, and leaves blank lines."""

import corpus_pipeline
from piisieve.llm import lines

SHORT = ["All rights reserved.", "les.", "a\tb\tc\td", "\u7248\u6743\u6240\u6709\u4fb5\u6743\u5fc5\u7a76"]


def test_short_lines_and_lines_without_spaces_go(spark):
    texts = {i: "\n".join([f"own{i}", *SHORT, "", " \t", "end"[:i % 3] + str(i)]) for i in range(24)}
    docs = spark.createDataFrame([(i, t, f"s{i % 12}") for i, t in texts.items()], "doc_id bigint, text string, source string")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert out[0] == texts[0]
    assert all(out[i] == "\n".join([f"own{i}", "", " \t", "end"[:i % 3] + str(i)]) for i in range(1, 24))
    assert {r.n_removed for r in lines.report(docs).collect()} == {0, 4}
