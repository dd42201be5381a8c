"""Candidates by occurrence: positions, token edges, overlaps, segments, verdicts of values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from piisieve import catalogue as cat
from piisieve.operators import detect, verify

SF_SMALL = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain(text, rules=cat.DETECTION_RULES):
    """(entity_type, value, 1-based position) by Python's regular expressions, rule by rule."""
    kept = []
    for etype, _, pattern, group in rules:
        for m in re.finditer(pattern, text or "", re.ASCII):
            a, b = m.span(group)
            value = m.group(group)
            if etype == "IPV4" and max(map(int, value.split("."))) > 255:
                continue
            if etype in cat.DETECTION_EDGES:
                left, right = cat.DETECTION_EDGES[etype]
                if re.search(left.replace(r"\z", r"\Z"), text[max(0, a - 2):a]) or re.search(right, text[b:b + 2]):
                    continue
            if not any(x < b and a < y for x, y, *_ in kept):
                kept.append((a, b, etype, value))
    return sorted((etype, value, a + 1) for a, b, etype, value in kept)


def found(df, **options):
    out = {}
    for r in detect.detect_candidates(df, **options).collect():
        out.setdefault(r.doc_id, []).append((r.entity_type, r.entity_value, r.pos))
    return {k: sorted(v) for k, v in out.items()}


def test_every_occurrence_in_its_own_context(spark):
    text = ("Syntax sample: jane.doe@mail.com is the format of it. " + "filler words " * 20
            + "then contact me at jane.doe@mail.com, my personal email")
    rows = sorted(verify.verify_candidates(detect.detect_candidates(frame(spark, [text]))).collect(), key=lambda r: r.pos)
    assert [r.verified for r in rows] == [False, True]
    assert all(text[r.pos - 1:].startswith(r.entity_value) for r in rows)
    (value,) = verify.value_verdicts(verify.verify_candidates(detect.detect_candidates(frame(spark, [text])))).collect()
    assert value.verified and value.n_occurrences == 2 and value.n_verified == 1 and value.first_pos == rows[1].pos


def test_values_inside_longer_tokens(spark):
    rows = found(frame(spark, ["11.2.3.45 then 1.2.3.4", "1234567-89-12345678", "v1.2.3.4.5", "at 1.2.3.4. End", "x555-123-4567"]))
    assert rows == {0: [("IPV4", "1.2.3.4", 16), ("IPV4", "11.2.3.45", 1)], 3: [("IPV4", "1.2.3.4", 4)]}


def test_overlaps_go_to_the_earlier_rule(spark):
    text = 'token: "call 555-123-4567 or mail a.b@example.com" and password = "plain words here"'
    assert found(frame(spark, [text]))[0] == [("EMAIL", "a.b@example.com", 35), ("PHONE", "555-123-4567", 14),
                                              ("SECRET", "plain words here", 68)]
    own = [("AB", "x", "[a-d]{4}", 0), ("CD", "y", "[c-f]{4}", 0), ("EF", "z", "[e-h]{4}", 0)]
    assert found(frame(spark, ["abcdefgh"]), rules=own)[0] == [("AB", "abcd", 1), ("EF", "efgh", 5)]
    assert found(frame(spark, ["abcdefgh"]), rules=own[::-1])[0] == [("AB", "abcd", 1), ("EF", "efgh", 5)]
    assert found(frame(spark, ["abcdefgh"]), rules=[own[1], own[0], own[2]])[0] == [("CD", "cdef", 3)]


def hard_texts(seed):
    rng = random.Random(seed)
    values = ["jane.doe@mail.com", "1.2.3.4", "999.1.1.1", "123-45-6789", "555-123-4567", "(555) 123-4567", "4111 1111 1111 1111",
              "MRN-123456", "DEUTDEFF500", 'token = "abcdef 1.2.3.4"', 'password: "x', '"', "é", "数据", "GB" + "1" * 20, "a" * 30]
    out = [None, "", "\n", "\n" * 300, "1.2.3.4", "1.2.3.4\n" * 400]
    for _ in range(60):
        n = rng.choice([3, 30, 400])
        out.append("".join(rng.choice(values) + rng.choice([" ", "\n", "", ", ", ".", "\r\n", "x" * 40]) for _ in range(n)))
    return out


@pytest.mark.parametrize("size", [240, 1000, 1 << 20])
def test_same_as_plain_at_every_segment_size(spark, size):
    texts = hard_texts(3)
    got = found(frame(spark, texts), segment_chars=size)
    want = {i: p for i, t in enumerate(texts) if (p := plain(t))}
    assert got == want


def test_segment_size_changes_nothing(spark):
    docs = frame(spark, hard_texts(4)).union(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"))
    sizes = [sorted(map(tuple, verify.verify_documents(docs, segment_chars=n).collect()), key=str) for n in (240, 4000, 1 << 20)]
    assert sizes[0] == sizes[1] == sizes[2] and sizes[0]
    in_row = detect.detect_arrays(docs).select("doc_id", F.inline("candidates"))
    assert sorted(map(tuple, in_row.collect()), key=str) == sorted(map(tuple, detect.detect_candidates(docs, segment_chars=240).collect()), key=str)


def test_segments_are_the_text(spark):
    texts = hard_texts(5)
    rows = detect.segments(frame(spark, texts), size=240).collect()
    for i, t in enumerate(texts):
        own = sorted((r._base, r.text, r._left, r._right) for r in rows if r.doc_id == i and r.text is not None)
        assert "".join(r[1] for r in own) == (t or "")
        for base, text, left, right in own:
            assert left == t[max(0, base - 120):base] and right == t[base + len(text):base + len(text) + 120]
    with pytest.raises(ValueError):
        detect.segments(frame(spark, texts), size=100)


def test_wide_windows(spark):
    docs = frame(spark, ["call me " + "x " * 100 + "555-123-4567"])
    assert not verify.verify_documents(docs).first().own
    assert verify.verify_documents(docs, window=300).first().own
    with pytest.raises(ValueError):
        verify.verify_candidates(detect.detect_candidates(docs), window=300)


def test_given_values_by_any_occurrence(spark):
    text = "Syntax sample: a.b@c.org is the format. " + "filler " * 40 + "my personal email is a.b@c.org"
    rows = [("r1", text, "EMAIL", "a.b@c.org"), ("r2", text, "EMAIL", "not.there@c.org"), ("r3", text, "EMAIL", ""),
            ("r4", "odd \\E.x+ \\E.x+", "EMAIL", "\\E.x+"), ("r5", None, "EMAIL", "x"), ("r6", text, "EMAIL", None)]
    df = spark.createDataFrame(rows, "recordId string, input string, entityType string, entityValue string")
    cands = verify.entity_candidates(df).collect()
    at = lambda k: [r.pos for r in cands if r.recordId == k]
    assert at("r1") == [16, text.rindex("a.b@c.org") + 1] and at("r2") == [0] and at("r3") == [0] and at("r4") == [5, 11]
    out = {r.recordId: r for r in verify.verify_entities(df).collect()}
    assert len(out) == 6 and out["r1"].verified and out["r1"].pos == text.rindex("a.b@c.org") + 1


def test_match_outputs_without_an_order_is_deterministic(spark):
    inp = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2)], "recordId string, input string, o long")
    out = spark.createDataFrame([("r1", True), ("r1", False)], "recordId string, verified boolean")
    got = {tuple(verify.match_outputs(inp.repartition(n), out.repartition(n)).first()) for n in (1, 2, 5)}
    assert len(got) == 1
    assert verify.match_outputs(inp, out, order_col="o").first().input == "b"
