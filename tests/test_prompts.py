"""Prompt invariants (the reference's prompt checks, on our own wording)."""

from pyspark.sql import functions as F

from piisieve import catalogue as cat
from piisieve.operators import prompts
from piisieve.functions.text import py_list_repr


def _prompt(spark, text, labels, reasoning):
    df = spark.createDataFrame([(text, labels, reasoning)], "t string, l array<string>, r boolean")
    return df.select(prompts.batch_prompt(F.col("t"), F.col("l"), F.col("r")).alias("p")).first().p


def test_reasoning_prompt_invariants(spark):
    sample = "Contact john.doe@company.com or call 1-800-555-0123 for support"
    p = _prompt(spark, sample, ["Email Address", "Phone Number"], True)
    for phrase in ["CRITICAL", "valid JSON", "escaped", "opening brace", "closing brace",
                   "double quotes", "trailing commas", "EXACT format", '"results"']:
        assert phrase in p, phrase
    assert sample in p and "{element_descriptions}" not in p
    assert "- **Email Address**: " in p and "['Email Address', 'Phone Number']" in p


def test_simple_prompt_invariants(spark):
    p = _prompt(spark, "t", ["Email Address"], False)
    assert "comma-separated" in p.lower() and '"results"' not in p


def test_placeholders_in_text_are_not_substituted_twice(spark):
    p = _prompt(spark, "literal {detected_piis} stays", ["X"], False)
    assert "literal {detected_piis} stays" in p


def test_descriptions_defaults(spark):
    df = spark.createDataFrame([(["Unknown Label"],), ([],)], "l array<string>")
    got = [r.d for r in df.select(prompts.describe_labels(F.col("l")).alias("d")).collect()]
    assert got == [f"- **Unknown Label**: {cat.NO_DESCRIPTION}", cat.NO_PIIS]


def test_list_repr(spark):
    df = spark.createDataFrame([(["a", "it's"],)], "l array<string>")
    assert df.select(py_list_repr(F.col("l")).alias("x")).first().x == "['a', \"it's\"]"


def test_chat_messages(spark):
    df = spark.createDataFrame([("p",)], "p string")
    r = df.select(prompts.chat_messages(F.col("p"), "system_user").alias("a"),
                  prompts.chat_messages(F.col("p"), "user").alias("b"),
                  prompts.chat_messages(F.col("p"), "raw").alias("c")).first()
    assert [m.role for m in r.a] == ["system", "user"] and len(r.b) == 1 and r.c == []


def test_catalogue_from_table(spark):
    cat_df = spark.createDataFrame([("Salary", "pay", "Financial Data")], "name string, description string, category string")
    m = prompts.catalogue_map_from(cat_df)
    df = spark.createDataFrame([(["Salary", "Other"],)], "l array<string>")
    d = df.select(prompts.describe_labels(F.col("l"), m).alias("d")).first().d
    assert d == f"- **Salary**: pay\n- **Other**: {cat.NO_DESCRIPTION}"
