"""Consolidation semantics (FIXTURES §6.3)."""

from piisieve.operators import consolidate as C

ITEM = "array<struct<pii:string,verified:boolean,reason:string>>"
SCHEMA = f"recordId string, input string, model string, load_order long, verified_piis {ITEM}"


def _long(spark, rows):
    return C.results_long(spark.createDataFrame(rows, SCHEMA))


def test_pivot_rules(spark):
    long_text = "x" * 201
    rows = [
        ("r1", "first text", "m1", 0, [("Email Address", True, "a, \"quoted\"\nline")]),
        ("r1", "second text", "m2", 1, [("Email Address", False, "b"), ("Phone Number", True, "c")]),
        ("r1", "first text", "m1", 2, [("Email Address", False, "late")]),   # duplicate: last wins
        ("r2", long_text, "m2", 1, [("Phone Number", None, None)]),
    ]
    out = {(r.record_id, r.pii): r for r in C.consolidate(_long(spark, rows), ["m1", "m2"]).collect()}
    r = out[("r1", "Email Address")]
    assert r.input_text == "first text"                       # first seen input wins
    assert (r.m1_Verified, r.m1_Reason) == ("NO", "late")     # last seen verdict wins
    assert (r.m2_Verified, r.m2_Reason) == ("NO", "b")
    p = out[("r1", "Phone Number")]
    assert (p.m1_Verified, p.m1_Reason) == ("N/A", "Not processed by this model")
    q = out[("r2", "Phone Number")]
    assert q.input_text == "x" * 197 + "..." and q.m2_Verified == "NO" and q.m2_Reason == "No reason provided"
    assert len(out) == 3


def test_truncation_boundary(spark):
    rows = [("r", "y" * 200, "m", 0, [("A", True, "r")])]
    assert _long(spark, rows).first().input_text == "y" * 200


def test_consensus_and_rollup(spark):
    rows = [("r1", "t", "m1", 0, [("A", True, "x")]), ("r1", "t", "m2", 1, [("A", False, "y")]),
            ("r2", "t", "m1", 0, [("A", True, "x")]), ("r2", "t", "m2", 1, [("A", True, "y")])]
    lg = _long(spark, rows)
    c = {r.record_id: r for r in C.consensus(lg).collect()}
    assert c["r1"].all_agree is False and c["r1"].vote_share == 0.5
    assert c["r2"].all_agree is True and c["r2"].all_verified is True
    rb = {(r.pii, r.model, r.level): r.rejection_rate for r in C.rejection_by_type(lg).collect()}
    assert rb[("A", "m2", 0)] == 0.5 and rb[(None, None, 3)] == 0.25


def test_batch_results_short_circuit(spark):
    recs = spark.createDataFrame([(1, []), (2, ["Email Address"])], "doc_id long, PIIs array<string>")
    labels = spark.createDataFrame([(2, "rules_strict_reasoning", "Email Address", True, "ok")],
                                   "doc_id long, model string, label string, verified boolean, reason string")
    b = C.batch_results(recs, labels, C.RULE_MODELS[:1])
    s = {r.doc_id: r for r in C.batch_result_summary(b).collect()}
    assert s[1].short_circuit and s[1].n_verified == 0 and s[1].confidence == 0.0
    assert s[2].verified == "Email Address" and s[2].rejected == "" and s[2].confidence == 1.0


def test_in_row_and_table_forms_agree(spark):
    from pyspark.sql import functions as F

    from piisieve.operators import detect

    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    arr = detect.detect_arrays(docs).select("doc_id", "candidates", "PIIs")
    in_row = C.batch_results_in_row(arr).select("doc_id", "model", "verified_piis")
    cands = detect.detect_candidates(docs)
    labels = C.label_verdicts(C.candidate_model_verdicts(cands))
    recs = arr.select("doc_id", "PIIs")
    table = C.batch_results(recs, labels).select("doc_id", "model", "verified_piis")
    assert in_row.count() == table.count()
    assert in_row.exceptAll(table).count() == 0


def test_pivot_cell_count_invariant(spark):
    from pyspark.sql import functions as F

    from piisieve.plans import queries as Q

    from conftest import SF_SMALL
    models = [m.name for m in C.RULE_MODELS]
    lg = Q.rule_long(spark, SF_SMALL)
    wide = C.consolidate(lg, models)
    filled = sum(wide.filter(F.col(f"{m}_Verified") != "N/A").count() for m in models)
    assert filled == lg.select("record_id", "pii", "model").distinct().count()
    assert wide.count() == lg.select("record_id", "pii").distinct().count()
