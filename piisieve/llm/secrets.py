"""Secret scans: fixed patterns and two character Markov models, in Spark SQL functions only.

Base spans are the leftmost matches of three patterns. The method adds runs of key characters
that look random: first-order Markov models of random strings and of ordinary identifiers
give each run a log-likelihood ratio per transition. The random model is trained on uniform
strings of every key alphabet (``KEY_ALPHABETS``, as expected counts of pairs, so nothing is
drawn) besides what the base patterns match; the ordinary one on the other runs of the same
sample. The sample is at most ``SAMPLE_DOCS`` documents with base matches and as many
of all documents, those with the smallest hash of id and text, rows alike counted once
(documented bounds). Only hashes are sorted to pick them. Training is an aggregation to at most
two counts for each pair of characters, which come to the driver.

``MIN_RATIO`` was set on sf0.1, trained on one half of the documents (by id hash): none of the
917 runs outside base spans in the other half reach it (the highest is at -0.39), nor do
24,000 identifiers of 12 styles made from its words. Of 2,000 uniform strings per case, 95.0 % (hex)
and 99.6 to 100 % (base32, upper case and digits, base62, base64) of 16 characters do, 99.1 and
100 % of 32. The threshold was picked from these same figures. Rules of two alternating signs
(``-=-=-=``) reach it too. Keys that no base pattern matches train the ordinary model if they are
in the sample: with 80 keys planted among the documents of sf0.001, 5 were missed.

Offsets are code points: a pattern's matches and the gaps that ``split`` leaves between them
alternate, so lengths add up to positions.

Defined cases: null texts count as empty; without ordinary runs that model is uniform, and characters
seen in few pairs are drawn to it; matches that fail their length rule are dropped but consume their text; repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged

#: fixed values: kind, pattern, group whose length counts, least length
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
#: the same kinds as one test of whether a text has any span: no shorter run can pass
LIKELY = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_UPPER, _LOWER, _DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: what keys are drawn from: hex, base32, upper case and digits, base62, both kinds of base64
KEY_ALPHABETS = [_DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _UPPER + _DIGITS[2:8], _UPPER + _DIGITS, _UPPER + _LOWER + _DIGITS,
                 _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_"]
#: transitions of uniform strings of each alphabet that the random model is trained on (expected counts, no draws)
KEY_PAIRS = 100_000
RUN = r"[A-Za-z0-9+/_=-]+"
MIN_RUN = 16
MIN_RATIO = 0.3
SAMPLE_DOCS = 2000
#: share of a uniform choice in the models of ordinary and of random strings
UNIFORM = (0.1, 0.2)
_SPAN = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters: start, end (code points), value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("all"), value.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["all"])
        found = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        keep = F.when(F.char_length(part["value"]) >= least, F.array(found)).otherwise(F.array().cast(_SPAN))
        return F.struct(end.alias("at"), F.concat(state["out"], keep).alias("out"))

    return F.aggregate(parts, empty, step, lambda state: state["out"])


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with the base spans of each kind as columns named after it."""
    none = F.array().cast(_SPAN)
    return docs.withColumns({kind: F.when(F.col("text").rlike(LIKELY[kind]), spans(F.col("text"), pattern, group, least))
                             .otherwise(none) for kind, pattern, group, least in BASE})


def _pairs(values: DataFrame) -> DataFrame:
    """Counts of adjacent characters of the alphabet by label."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("value") - 1))
    steps = values.where(F.char_length("value") > 1).select("label", "value", at.alias("i"))
    a, b = F.expr("substring(value, i, 1)"), F.expr("substring(value, i + 1, 1)")
    return steps.select("label", a.alias("a"), b.alias("b")).where(
        F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET)).groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of every pair of characters, row by row."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    likely = F.lit(False)
    for kind, _, _, _ in BASE:
        likely = likely | F.col("text").rlike(LIKELY[kind])
    keys = staged(keyed.select("_key", likely.alias("likely")).groupBy("_key").agg(F.max("likely").alias("likely")),
                  "secret-keys")
    pick = lambda df: df.select("_key").orderBy("_key").limit(sample_docs)
    chosen = pick(keys.where("likely")).unionByName(pick(keys)).distinct()
    # at most 2 * sample_docs keys: a proven bound for the broadcast
    texts = keyed.join(F.broadcast(chosen), "_key").select("_key", "text").dropDuplicates(["_key"])
    sample = staged(with_base(texts), "secret-sample")
    random = sample.select(F.lit(1).alias("label"), F.explode(F.concat(
        *[F.transform(kind, lambda s: s["value"]) for kind, _, _, _ in BASE])).alias("value"))
    taken = F.concat(*[F.transform(kind, lambda s: s["value"]) for kind, _, _, _ in BASE])
    ordinary = sample.select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("value"), taken.alias("taken"))
    ordinary = ordinary.where(~F.array_contains("taken", F.col("value"))).select(F.lit(0).alias("label"), "value")
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in _pairs(random.unionByName(ordinary)).collect()}
    return log_ratios(counts)


def log_ratios(counts: dict[tuple[int, str, str], float]) -> list[float]:
    """Log-likelihood ratios of all pairs, from counted pairs and ``KEY_PAIRS`` of each kind of uniform string."""
    counts = dict(counts)
    for letters in KEY_ALPHABETS:
        for a in letters:
            for b in letters:
                counts[1, a, b] = counts.get((1, a, b), 0) + KEY_PAIRS / len(letters) ** 2
    ratios = []
    for a in ALPHABET:
        chance = []
        for label, share in enumerate(UNIFORM):
            total = sum(counts.get((label, a, b), 0) for b in ALPHABET)
            share = max(share, len(ALPHABET) / (len(ALPHABET) + total))
            chance.append([(1 - share) * counts.get((label, a, b), 0) / (total or 1) + share / len(ALPHABET) for b in ALPHABET])
        ratios += [math.log(random / plain) for plain, random in zip(*chance)]
    return ratios


def ratio(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a run of key characters."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")      # folds to one literal
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1))) - 1
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(value) - 1), F.lit(0.0),
                        lambda acc, i: acc + F.get(table, code(i) * len(ALPHABET) + code(i + 1)))
    return total / (F.char_length(value) - 1)


def scanned(docs: DataFrame, min_ratio: float = MIN_RATIO, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, base spans by kind (``assign``, ``access``, ``hex``) and the method's (``markov``)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ratios = train(rows, sample_docs)
    found = with_base(rows)
    long = RUN[:-1] + "{%d}" % MIN_RUN
    runs = F.when(F.col("text").rlike(long), spans(F.col("text"), RUN[:-1] + "{%d,}" % MIN_RUN, 0, MIN_RUN)).otherwise(
        F.array().cast(_SPAN))
    known = F.concat("assign", "access", "hex")
    extra = F.filter(runs, lambda s: (ratio(s["value"], ratios) >= min_ratio)
                     & ~F.exists(known, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])))
    return found.withColumn("markov", extra).drop("text")


def _listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    def rows_of(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(
            ":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("x")))

    rows = F.concat(*[rows_of(n, kind) for n, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["x"]), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (of all kinds)."""
    kinds = [b[0] for b in BASE]
    return scanned(docs).select(
        "doc_id", *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in kinds],
        F.sha2(_listed(kinds), 256).alias("base_sha256"), _listed([*kinds, "markov"]).alias("spans"))
