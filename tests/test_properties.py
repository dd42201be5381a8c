"""Property checks: parsed simple-mode labels stay within the detected list
except on the JSON fallback path, which the reference returns unvalidated."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piisieve.operators import replies as R

LABELS = ["Email Address", "Phone Number", "Home Address", "Salary"]
pieces = st.sampled_from(LABELS + ["email", "NONE", "none", "Here is the list:", "I apologize", ", ", ",",
                                   "\n", " ", "{", "}", '"verified_piis": ["Salary"]', "address line", "x"])


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(pieces, max_size=8).map("".join),
                          st.lists(st.sampled_from(LABELS), min_size=1, max_size=3, unique=True)),
                min_size=200, max_size=200))
def test_simple_parse_subset(spark, cases):
    df = spark.createDataFrame(cases, "r string, d array<string>")
    rows = df.select("d", R.parse_simple(F.col("r"), F.col("d")).alias("p")).collect()
    for r in rows:
        if r.p.parse_path != "P-14":
            assert set(r.p.verified) <= set(r.d), (r.p.parse_path, r.p.verified, r.d)
        assert len(r.p.verified) == len(set(r.p.verified)) or r.p.parse_path == "P-14"


reasoning_pieces = st.sampled_from(['{"results": [', '{"pii": "Salary", "verified": true, "reason": "r"}', "]}",
                                    "```json\n", "\n```", "```", '{"answer": 1}', "text", " and ", "}", "{",
                                    ": True", ", "])


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(reasoning_pieces, max_size=8).map("".join),
                          st.lists(st.sampled_from(LABELS), min_size=1, max_size=3, unique=True)),
                min_size=200, max_size=200))
def test_reasoning_fallbacks_cover_every_label(spark, cases):
    df = spark.createDataFrame(cases, "r string, d array<string>")
    rows = df.select("d", R.parse_reasoning(F.col("r"), F.col("d")).alias("p")).collect()
    fixed = {"P-04": False, "P-06": False, "P-07": False, "P-08": True}
    for r in rows:
        if r.p.parse_path in fixed:
            assert [i.pii for i in r.p.items] == list(r.d)
            assert all(i.verified is fixed[r.p.parse_path] for i in r.p.items)
        else:
            assert r.p.parse_path == "P-05"
