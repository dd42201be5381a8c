"""Base counts of the quality rules against plain Python, over all of a small documents table and hard texts."""

import re
from collections import Counter

from piisieve.llm import quality
from piisieve.llm.base import table

SF = "/root/testdata/sf0.001"
HARD = [None, "", " \t\r\n", "é x é x", "a\n\na\n a\na\r\n", "#*$%&|<> \U0001f600|", "one two " * 40, "same line here\n" * 9,
        " ".join(str(i % 11) for i in range(70)), "x\x0by\x0cz\x1fw", "ab\n" + " ".join(map(str, range(30))) + "\nab"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = Counter(line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line))
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    found = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if found[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(lines.values()) - len(lines),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_base_counts_match_plain_python(spark):
    given = table(spark, SF, "documents").select("doc_id", "text")
    hard = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    docs = given.unionByName(hard.selectExpr("cast(doc_id as " + given.schema["doc_id"].dataType.simpleString() + ") doc_id", "text"))
    rows = quality.report(docs, table(spark, SF, "labels")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}
    assert len(rows) == docs.count() and not any(r.kept for r in rows if r.base_failed)
