"""Repeated benchmark rows are removed before blocks are dealt."""

from piisieve.llm import decontaminate


def test_repeated_items_reach_a_block_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(7, text)] * 300 + [(8, text), (None, text), (None, text)], "item_id bigint, text string")
    rows, staged = {}, decontaminate.staged

    def counted(df, name):
        out = staged(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "staged", counted)
    docs = spark.createDataFrame([(1, "head " + text)], "doc_id bigint, text string")
    got = decontaminate.report(docs, bench).collect()[0]
    assert rows["items"] == 3 and (got.n_hit, got.n_items) == (30, 2)
