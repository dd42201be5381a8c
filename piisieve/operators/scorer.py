"""Scorers: the plug-in hook for real models (J-08) and a seeded stand-in reply model.

``score_with`` runs a user ``Scorer`` through ``mapInPandas``: the scorer is built once per
Python worker, receives Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` is
the micro-batch size) and returns replies plus per-item latency (batch time / batch size,
F-04). Filter first, score once, materialise the replies, then parse them with Columns.

``simulated_replies`` is a deterministic stand-in for an LLM: replies are rendered with
Spark expressions from the detected labels and md5 draws, and cover every parser branch
(clean lists, garbage prefixes, NONE, fenced or Python-flavoured JSON, truncated JSON,
trailing data, empty replies). It lets the parsing jobs run on the driver tables with an
exact DuckDB twin.
"""

from __future__ import annotations

import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draw import draw

# ----------------------------------------------------------------------------- plug-in (J-08)


class Scorer:
    """Interface of a pluggable scorer. ``score`` gets a pandas DataFrame with the input
    columns and returns a list/Series of reply strings of the same length."""

    def score(self, batch):  # pragma: no cover - interface
        raise NotImplementedError


def score_with(df: DataFrame, factory: Callable[[], Scorer], out_col: str = "raw_response") -> DataFrame:
    """Apply a scorer to every row; adds ``out_col`` and ``latency_ms`` (per item)."""
    key = uuid.uuid4().hex      # two factories may share module and name
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{out_col}` string, latency_ms double"

    def run(batches: Iterator) -> Iterator:
        # a module of our own, made on the worker: it outlives single tasks
        home = sys.modules.setdefault("piisieve_scorers", types.ModuleType("piisieve_scorers"))
        cache = home.__dict__.setdefault("built", {})
        scorer = cache.get(key)
        if scorer is None:  # build the model once per Python worker process
            scorer = cache[key] = factory()
        for pdf in batches:
            if len(pdf) == 0:
                continue
            t0 = time.perf_counter()
            replies = list(scorer.score(pdf))
            per_item = (time.perf_counter() - t0) * 1000.0 / len(pdf)
            yield pdf.assign(**{out_col: replies, "latency_ms": round(per_item, 2)})

    return df.mapInPandas(run, schema)


class KeywordScorer(Scorer):
    """A tiny example scorer: verifies every detected label whose first word occurs in the
    text (simple-mode reply). Real deployments plug a neural model in here."""

    def score(self, batch):
        out = []
        for text, labels in zip(batch["input"], batch["detected_piis"]):
            low = (text or "").lower()
            keep = [l for l in (labels if labels is not None else [])
                    if l.split(" ")[0].lower() in low]
            out.append(", ".join(keep) if keep else "NONE")
        return out


# ----------------------------------------------------------------------------- stand-in replies
KEEP_REASON = "Tied to one person"
DROP_REASON = "Organisational or system value"


def _keep(id_col: str):
    return lambda d: draw("keep", 10, F.col(id_col), d) < 7


def simple_reply(id_col: str, labels: Column) -> Column:
    """Simple-mode reply (comma-separated labels) with seeded variations."""
    kept = F.filter(labels, _keep(id_col))
    vs = F.when(F.size(kept) == 0, F.lit("NONE")).otherwise(F.array_join(kept, ", "))
    firsts = F.when(F.size(kept) == 0, F.lit("NONE")).otherwise(
        F.array_join(F.transform(kept, lambda v: F.substring_index(v, " ", 1)), ", "))
    as_json = F.concat(F.lit('superf00k {"verified_piis":['),
                       F.array_join(F.transform(kept, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ","),
                       F.lit("]}"))
    k = draw("simple", 10, F.col(id_col))
    return (F.when(k <= 1, vs)
            .when(k == 2, F.concat(F.lit("Here is the list: "), vs))
            .when(k == 3, F.lower(vs))
            .when(k == 4, firsts)
            .when(k == 5, F.concat(vs, F.lit("\nThese are verified.")))
            .when(k == 6, F.concat(F.lit("I apologize, "), vs))
            .when(k == 7, as_json)
            .when(k == 8, F.lit(""))
            .otherwise(F.lit("Salary, Weight")))


def reasoning_reply(id_col: str, labels: Column) -> Column:
    """Reasoning-mode reply (JSON results) with seeded variations and defects."""
    keep = _keep(id_col)

    def item(d):
        return F.concat(F.lit('{"pii": "'), d, F.lit('", "verified": '),
                        F.when(keep(d), F.lit("true")).otherwise(F.lit("false")),
                        F.lit(', "reason": "'),
                        F.when(keep(d), F.lit(KEEP_REASON)).otherwise(F.lit(DROP_REASON)),
                        F.lit('"}'))

    body = F.concat(F.lit('{"results": ['), F.array_join(F.transform(labels, item), ", "), F.lit("]}"))
    k = draw("reasoning", 10, F.col(id_col))
    return (F.when(k <= 2, body)
            .when(k == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(k == 4, F.replace(F.replace(body, F.lit(": true"), F.lit(": True")),
                                    F.lit(": false"), F.lit(": False")))
            .when(k == 5, F.lit("```"))
            .when(k == 6, F.lit('{"answer": []}'))
            .when(k == 7, F.lit("I cannot say."))
            .when(k == 8, F.substring(body, 1, F.instr(body, "}")))
            .otherwise(F.concat(body, F.lit(' and {"x": 1}'))))


SINGLE_REPLIES = [
    'Result: {"verified": true, "confidence": 0.83, "reason": "Personal contact"} end',
    '{"verified": false}',
    "Yes, this is personal data",
    "no",
    "{verified: maybe}",
    '{"verified": true, "confidence": "high"}',
]


def single_reply(id_col: str, value: Column) -> Column:
    """Single-entity reply (deprecated path) chosen by a draw per (record, value)."""
    k = draw("single", len(SINGLE_REPLIES), F.col(id_col), value)
    expr = None
    for i, r in enumerate(SINGLE_REPLIES):
        expr = F.when(k == i, F.lit(r)) if expr is None else expr.when(k == i, F.lit(r))
    return expr


def simulated_replies(records: DataFrame, mode: str, id_col: str = "doc_id",
                      labels_col: str = "PIIs") -> DataFrame:
    """Add ``raw_response`` for records with at least one detected label (others are
    short-circuited and get no reply)."""
    from .rows import keep_if
    fn = simple_reply if mode == "simple" else reasoning_reply
    kept = keep_if(records, lambda r: F.size(r[labels_col]) > 0)
    return kept.withColumn("raw_response", fn(id_col, F.col(labels_col)))


# ----------------------------------------------------------------------------- stand-in spans / tokens
TOKEN_LABELS = ["O", "B-PHI", "I-PHI", "B-ID", "I-ID"]


def _score(seed: str, id_col: str, value: Column, k: int) -> Column:
    return draw(seed, 100, F.col(id_col), value, k) / F.lit(100.0)


def simulated_spans(id_col: str, value: Column, context: Column, ctx_offset: Column) -> Column:
    """Span-scorer stand-in: [word before the value, first 4 chars of the value, the value]
    with seeded scores in [0, 0.99]."""
    before = F.regexp_replace(F.substring(context, F.lit(1), ctx_offset), " +$", "")
    neighbor = F.regexp_extract(before, "([^ ]*)$", 1)
    texts = [neighbor, F.substring(value, 1, 4), value]
    return F.array(*[F.struct(t.alias("text"), _score("span", id_col, value, k).alias("score"))
                     for k, t in enumerate(texts, 1)])


def simulated_tokens(id_col: str, value: Column, ctx_offset: Column) -> Column:
    """Token-classifier stand-in: five tokens around the value (one zero-width at its end)
    with seeded labels and probabilities; offsets are 0-based into the context."""
    o, n = ctx_offset, F.length(value)
    bounds = [(F.greatest(o - 5, F.lit(0)), o), (o, o + 3), (o + 3, o + n), (o + n, o + n),
              (o + n, o + n + 4)]
    toks = []
    for k, (s, e) in enumerate(bounds, 1):
        lab = F.element_at(F.array(*[F.lit(x) for x in TOKEN_LABELS]),
                           (draw("toklab", len(TOKEN_LABELS), F.col(id_col), value, k) + 1).cast("int"))
        toks.append(F.struct(lab.alias("label"), s.cast("int").alias("tok_start"),
                             e.cast("int").alias("tok_end"),
                             _score("tokprob", id_col, value, k).alias("prob")))
    return F.array(*toks)
