"""The classifier trains on every sampled row, however long other labelled texts are."""

from piisieve.llm import quality


def _docs(spark, long):
    good = [(i, f"plain report number {i} tells what happened in the town on that day", 1) for i in range(60)]
    bad = [(100 + i, f"buy cheap pills now {i} click win free casino bonus", 0) for i in range(60)]
    filler = [(200 + i, " ".join(f"{i}w{j * 7919 % 100003}" for j in range(long)), 1) for i in range(20)]
    rows = good + bad + filler
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")


def test_long_texts_do_not_thin_the_sample(spark, monkeypatch):
    docs, labels = _docs(spark, 40_000)
    trained = []
    fit = quality._fit
    monkeypatch.setattr(quality, "_fit", lambda sample: trained.append(sample.count()) or fit(sample))
    weights, slope, _ = quality.train(docs, labels)
    assert trained == [140] and len(weights) == quality.DIMS + 1 and slope > 0


def test_verdicts_separate_the_classes(spark):
    docs, labels = _docs(spark, 40_000)
    p = {r.doc_id: r.probability for r in quality.report(docs, labels).collect()}
    assert min(p[i] for i in range(60)) > 0.5 > max(p[100 + i] for i in range(60))
