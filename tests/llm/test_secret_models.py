"""The Markov models find keys of every alphabet and leave plain identifiers, trained on sf0.01."""

import random

from pyspark.sql import functions as F

from piisieve.llm import secrets
from piisieve.llm.base import table

SF = "/root/testdata/sf0.01"
PLAIN = ["internationalization", "getElementsByClassName", "the-quick-brown-fox-jumps", "max_number_of_retries",
         "/home/user/documents/report", "1805396481774514", "MAX_NUMBER_OF_RETRIES", "article/2019/07/some-title"]


def test_planted_keys_and_plain_identifiers(spark):
    rng = random.Random(11)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base62 = secrets.ALPHABET[:62]
    keys = [draw(base62, n) for n in (16, 20, 32, 64) for _ in range(10)]
    keys += [p + draw(base62, n) for p, n in (("ghp_", 36), ("sk_live_", 24), ("AIza", 35), ("xoxb-", 24)) for _ in range(5)]
    keys += [draw(letters, 32) for letters in secrets.KEY_ALPHABETS[2:] for _ in range(4)]
    given = table(spark, SF, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    planted = [(-1 - i, f"see {v} here") for i, v in enumerate(keys + PLAIN)]
    docs = given.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string"))
    rows = {r.doc_id: r for r in secrets.scanned(docs).where("doc_id < 0").collect()}
    found = [[s.value for s in rows[-1 - i].markov] for i in range(len(planted))]
    missed = [k for k, f in zip(keys, found) if f != [k]]
    assert len(missed) <= 1, missed       # of 80 keys; 99.4 % or more of each kind on held-out strings
    assert found[len(keys):] == [[]] * len(PLAIN)


def test_without_ordinary_runs_no_identifier_is_random(spark):
    df = spark.createDataFrame([(1, "getElementsByClassName"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.spans for r in secrets.report(df).collect()} == {1: "", 2: ""}
