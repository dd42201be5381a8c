"""Source divergence against plain Python, with and without digest collisions."""

import random
import re
from collections import Counter, defaultdict

import pytest

from piisieve.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, value string, rank int, digest string"


def plain(rows, min_docs=10, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = {s: c for (x, s), c in groups.items() if x == lang}
        whole = Counter()
        for c in sources.values():
            whole.update(c)

        def share(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (size + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in sources.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                some = sorted(some, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(some) if part == "pair" or i < top]
    return sorted(out)


def table(seed=1, n=240):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "x", "a1b", "naïve", *(f"w{c}{d}" for c in "abcdefgh" for d in "xyz")]
    rows = [(i, " ".join(rng.choices(words[:8 + i % 24], k=rng.randrange(40))), rng.choice(["en", "fr", None]),
             rng.choice(["a", "b", "c", None, "d"])) for i in range(n)]
    rows += [(None, None, "en", "quiet"), (3, "", "de", "one"), (3, "", "de", "two"), (4, "alone " * 50, "nl", "only")]
    return rows + rows[:5] + [(9, "the " * 30000 + "été", "en", "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", 5, "d") for r in rows], SCHEMA)


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_same_as_plain(spark, bits):
    """Few digest bits make nearly all terms collide; the result must not change."""
    rows = table()
    got = sorted(map(tuple, divergence.audit(frame(spark, rows).repartition(5), digest_bits=bits).collect()))
    assert got == plain(rows)


def test_ties_by_item(spark):
    rows = [(i, "bb aa cc dd éé", "en", "a") for i in range(12)] + [(i, "bb aa zz", "en", "b") for i in range(12)]
    rows += [(i, " ".join("k" + c for c in "qwertyuiopasdfgh"), "en", "c") for i in range(11)]
    got = sorted(map(tuple, divergence.audit(frame(spark, rows)).collect()))
    assert got == plain(rows)
    assert sum(r[1] == "c" and r[2] == "term" for r in got) == 10


def test_empty_table(spark):
    assert divergence.audit(frame(spark, table()).where("false")).count() == 0


def test_matrix_written_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MATRIX", 1)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    rows = table(seed=2)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == plain(rows)


def test_no_term_in_the_counting_shuffle(spark):
    docs = divergence._documents(frame(spark, table()))
    counts = docs.mapInArrow(divergence._count((1 << 64) - 1), "lang string, source string, digest bigint, n bigint, docs bigint")
    assert dict(counts.dtypes)["digest"] == "bigint" and "term" not in counts.columns
