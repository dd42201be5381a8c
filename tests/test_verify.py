"""Rule verifier: the reference's six sample records and guard behaviour."""

from pyspark.sql import functions as F

from piisieve.operators import detect, verify

SAMPLES = [
    ("test_001", "Mr. Adolphus Reagan Ziemann, as a Central Principal Applications Executive at McLaughlin, "
                 "Nader and Purdy, your knowledge of change management is vital.", ["First Name", "Past Roles or Positions"]),
    ("test_002", "Hi Alberta, there have been indications of compromised data linked with our server IP address "
                 "66.168.73.147. Could you draw up the necessary legal documentation?", ["First Name", "IP Address"]),
    ("test_003", "Mohammed Ali, a Bangladeshi national, was prescribed a new medication. His address (House No. 12, "
                 "Road 7) and his National ID Number (2512832512).", ["First Name", "Illness or Medical Condition",
                                                                     "Address", "Nationality"]),
    ("test_004", "Patient SSN 123-45-6789 requires authorization for surgery", ["Social Security Number"]),
    ("test_005", "Contact john.doe@company.com or call 1-800-555-0123 for support", ["Email Address", "Phone Number"]),
    ("test_006", "Bug ticket ID SSN-123-456 assigned to security team", ["Social Security Number"]),
]


def _label_verdicts(spark):
    recs = spark.createDataFrame(SAMPLES, "recordId string, input string, PIIs array<string>")
    cands = detect.detect_candidates(recs, id_col="recordId", text_col="input")
    verdicts = verify.verify_candidates(cands)
    out = verify.verify_labels(recs, verdicts)
    return {(r.recordId, r.pii): (r.verified, r.reason) for r in out.collect()}


def test_sample_records_stated_verdicts(spark):
    v = _label_verdicts(spark)
    assert v[("test_002", "IP Address")][0] is False          # server IP rejected
    assert v[("test_005", "Phone Number")][0] is False        # toll-free rejected
    assert v[("test_006", "Social Security Number")][0] is False  # ticket id rejected
    assert v[("test_004", "Social Security Number")][0] is True
    assert v[("test_005", "Email Address")][0] is True
    assert all(v[("test_001", p)][0] for p in ["First Name", "Past Roles or Positions"])
    assert len(v) == sum(len(s[2]) for s in SAMPLES)


def test_luhn(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("4111 1111 1111 1111",)], "v string")
    assert [r.ok for r in df.select(verify.luhn_ok(F.col("v")).alias("ok")).collect()] == [True, False, True]


def test_detection_counts_and_context(spark):
    text = "mail a.b@mail1.example.com or a.b@mail1.example.com; ip 10.0.0.1 and 999.1.1.1"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = {(r.entity_type, r.entity_value): r for r in detect.detect_candidates(df).collect()}
    places = [r.pos for r in detect.detect_candidates(df).where("entity_type = 'EMAIL'").collect()]
    assert places == [6, 31]
    assert ("IPV4", "999.1.1.1") not in rows            # octet > 255 is not an address
    r = rows[("IPV4", "10.0.0.1")]
    assert r.context[r.ctx_offset:r.ctx_offset + len("10.0.0.1")] == "10.0.0.1"
    v = verify.verify_candidates(detect.detect_candidates(df)).filter("entity_type = 'IPV4'").first()
    assert v.verified is False and v.own is False and v.spec is False and v.ctx is False


def test_uncertain_is_verified(spark):
    df = spark.createDataFrame([(1, "zz 70.23.22.57 zz")], "doc_id long, text string")
    v = verify.verify_candidates(detect.detect_candidates(df)).first()
    assert v.verified is True and v.own is None and v.reason == verify.REASON_UNCERTAIN


def test_confusion_metrics(spark):
    df = spark.createDataFrame([("A", True, True), ("A", True, False), ("A", False, True), ("B", False, False)],
                               "entityType string, verified boolean, is_true_positive boolean")
    m = {r.entityType: r for r in verify.confusion_metrics(df).collect()}
    assert (m["A"].tp, m["A"].fp, m["A"].fn, m["A"].tn) == (1, 1, 1, 0)
    assert m["A"].precision == 0.5 and m["A"].recall == 0.5 and m["A"].f1 == 0.5
    assert m["B"].precision is None and m["B"].fpr == 0.0
    assert m[None].tp == 1 and m[None].tn == 1


def test_match_outputs_last_wins_and_missing(spark):
    inp = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r2", "c", 1)], "recordId string, input string, o long")
    out = spark.createDataFrame([("r1", True, 1), ("r1", False, 5)], "recordId string, verified boolean, o long")
    joined = verify.match_outputs(inp, out, order_col="o").collect()
    assert len(joined) == 1
    missing = verify.match_outputs(inp, out, order_col="o", how="left_anti").collect()
    assert [r.recordId for r in missing] == ["r2"]


def test_in_row_label_verdicts_match_table_form(spark):
    recs = spark.createDataFrame(SAMPLES, "recordId string, input string, PIIs array<string>")
    table = _label_verdicts(spark)
    in_row = {(r.recordId, r.pii): (r.verified, r.reason) for r in verify.verify_labels_in_row(recs).collect()}
    assert in_row == table
