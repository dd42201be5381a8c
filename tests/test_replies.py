"""Reply parsing: one case per parser branch (FIXTURES §6.2)."""

import pytest
from pyspark.sql import functions as F

from piisieve import catalogue as cat
from piisieve.operators import replies as R

D = ["Email Address", "Phone Number"]


def _simple(spark, reply, detected=D):
    df = spark.createDataFrame([(reply, detected)], "r string, d array<string>")
    row = df.select(R.parse_simple(F.col("r"), F.col("d")).alias("p")).first().p
    return list(row.verified), row.parse_path


def _reasoning(spark, reply, detected=D):
    df = spark.createDataFrame([(reply, detected)], "r string, d array<string>")
    row = df.select(R.parse_reasoning(F.col("r"), F.col("d")).alias("p")).first().p
    return [(i.pii, i.verified, i.reason) for i in row.items], row.parse_path


def _single(spark, reply):
    df = spark.createDataFrame([(reply,)], "r string")
    p = df.select(R.parse_single(F.col("r")).alias("p")).first().p
    return p.verified, p.confidence, p.reason, p.parse_path


def test_single_json(spark):
    assert _single(spark, 'x {"verified": false, "confidence": 0.2} y') == (
        False, 0.2, cat.REASON_SINGLE_DEFAULT, "P-01")


def test_single_text(spark):
    assert _single(spark, "Yes, it is")[:3] == (True, 0.7, cat.REASON_SINGLE_TEXT)
    assert _single(spark, "no")[:2] == (False, 0.6)


def test_single_parse_error(spark):
    v, c, r, p = _single(spark, "{bad}")
    assert (v, c, p) == (True, 0.5, "P-03") and r.startswith("Parse error")


def test_reasoning_only_fence(spark):
    items, path = _reasoning(spark, "```")
    assert path == "P-04" and items == [(d, False, cat.REASON_EMPTY_REPLY) for d in D]


def test_reasoning_results_fenced_python_bools(spark):
    reply = '```json\n{"results": [{"pii": "Email Address", "verified": True, "reason": "r"}]}\n```'
    assert _reasoning(spark, reply) == ([("Email Address", True, "r")], "P-05")


def test_reasoning_bool_without_space_is_a_decode_error(spark):
    # the reference only rewrites ': True' (with a space); ':True' stays invalid JSON
    reply = '{"results":[{"pii":"Email Address","verified":True,"reason":"r"}]}'
    items, path = _reasoning(spark, reply)
    assert path == "P-08" and all(v for _, v, _ in items)


def test_reasoning_unvalidated_labels_kept(spark):
    reply = '{"results": [{"pii": "Salary", "verified": false, "reason": "x"}]}'
    assert _reasoning(spark, reply) == ([("Salary", False, "x")], "P-05")


def test_reasoning_wrong_structure(spark):
    items, path = _reasoning(spark, '{"answer": []}')
    assert path == "P-06" and {r for _, _, r in items} == {cat.REASON_BAD_STRUCTURE}


def test_reasoning_no_json(spark):
    items, path = _reasoning(spark, "cannot say")
    assert path == "P-07" and not any(v for _, v, _ in items)


@pytest.mark.parametrize("reply", ['{"results":[{"pii":"Email Address"}',
                                   '{"results":[]} and {"x":1}'])
def test_reasoning_decode_error_verifies_all(spark, reply):
    items, path = _reasoning(spark, reply)
    assert path == "P-08" and items == [(d, True, cat.REASON_DECODE_FAILED) for d in D]


@pytest.mark.parametrize("reply,detected,expected,path", [
    ("Here is the list: Email Address", D, ["Email Address"], "P-13"),
    ("NONE", D, [], "P-11"),
    ("none of them", D, [], "P-11"),
    ("Email Address, I apologize", D, ["Email Address"], "P-13"),
    ("phone number, PHONE NUMBER", D, ["Phone Number"], "P-13"),
    ("Email", D, ["Email Address"], "P-13"),
    ("Address line", ["Home Address", "Email Address"], ["Email Address"], "P-13"),
    ("number address, phone number", D, ["Phone Number"], "P-13"),
    ("Salary", D, [], "P-13"),
    ('superf00k {"verified_piis":["Email Address"]}', D, ["Email Address"], "P-14"),
    ("", D, D, "P-15"),
    ('{"verified_piis": [} superf00k', D, D, "P-15"),
])
def test_simple_branches(spark, reply, detected, expected, path):
    assert _simple(spark, reply, detected) == (expected, path)


def test_simple_verified_subset_of_detected(spark):
    replies = ["Email Address, Phone Number, Salary", "phone", "Here is: Phone Number"]
    for r in replies:
        got, _ = _simple(spark, r)
        assert set(got) <= set(D)


def test_invented_labels_flagged(spark):
    df = spark.createDataFrame(
        [('{"results": [{"pii": "Salary", "verified": true, "reason": "x"}, '
          '{"pii": "Email Address", "verified": true, "reason": "y"}]}', D)],
        "raw_response string, detected_piis array<string>")
    r = R.parse_replies(df, "reasoning").first()
    assert r.parse_path == "P-05" and r.n_invented == 1
