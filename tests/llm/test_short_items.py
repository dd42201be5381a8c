"""Whole benchmark items shorter than a window are cut from texts that are mostly something else."""

from piisieve.llm import decontaminate


def test_short_items_are_cut(spark):
    own = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{own} What is the capital of Peru? {own}"), (2, f"{own} the capital of {own}")],
                                 "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "What is the capital of Peru?")], "item_id bigint, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench).collect()}
    assert out == {1: f"{own} ? {own}", 2: f"{own} the capital of {own}"}
    assert {r.doc_id: r.n_hit for r in decontaminate.report(docs, bench).collect()} == {1: 6, 2: 0}
