"""The pipeline's stages one by one on a small table, against the operators' reports and brute force."""

import corpus_pipeline
from piisieve.llm import quality, simhash
from piisieve.llm.base import staged, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), "test")
        kept[name] = before, docs
        assert name == "packing" or docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = kept["quality rules"]
    assert ids(after) == ids(quality.report(before, table(spark, SF, "labels")).where("kept"))

    before, after = kept["line dedup"]
    assert ids(before) == ids(after)

    before, after = kept["SimHash near-dedup"]
    fps = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in before.select("doc_id", "text").collect()}
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for d in fps:
            least = min(root[x] for x in fps if (fps[x] ^ fps[d]).bit_count() <= 3)
            changed, root[d] = changed or least < root[d], min(least, root[d])
    assert ids(after) == sorted(set(root.values()))

    before, after = kept["benchmark decontamination"]
    assert set(ids(after)) <= set(ids(before))

    before, pieces = kept["packing"]
    assert {r.doc_id for r in pieces.collect()} == set(ids(before))
