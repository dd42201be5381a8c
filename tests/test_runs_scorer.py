"""Run tables (D-10, C-14, C-15, E-25) and the scorer plug-in (J-08)."""

from pyspark.sql import functions as F

from piisieve.operators import runs, scorer


def test_run_matrix(spark):
    m = runs.run_matrix(spark, [("alpha", "3b"), ("beta", "8b")], ["4bit", "fp16", "vllm"],
                        exclusions=[("beta", "fp16")])
    assert m.count() == 5
    sel = runs.run_matrix(spark, [("alpha", "3b"), ("beta", "8b")], ["4bit", "fp16"],
                          selected_models="alpha", selected_variations="fp16, 4bit")
    assert sel.count() == 2


def test_run_name(spark):
    df = spark.createDataFrame([("alpha", "3b", True, False, False, True), ("alpha", "3b", True, False, True, False)],
                               "model string, size string, quantize boolean, disable_quantization boolean, "
                               "use_vllm boolean, reasoning boolean")
    names = [r.n for r in df.select(runs.run_name().alias("n")).collect()]
    assert names == ["alpha_3b_4bit_reasoning", "alpha_3b_vllm"]


def test_run_tally(spark):
    df = spark.createDataFrame([("a", "success"), ("b", "failed"), ("c", "failed")], "run string, status string")
    t = runs.run_tally(df).first()
    assert (t.succeeded, t.failed, t.failed_runs) == (1, 2, ["b", "c"])


def test_scorer_plugin(spark):
    df = spark.createDataFrame([("call my phone", ["Phone Number", "Email Address"])],
                               "input string, detected_piis array<string>")
    out = scorer.score_with(df, scorer.KeywordScorer).first()
    assert out.raw_response == "Phone Number" and out.latency_ms >= 0
