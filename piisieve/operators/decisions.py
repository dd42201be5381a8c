"""Scorer-output decision tables (J-09 logits, J-10 spans, J-11 token labels).

Each turns a scorer's raw output column into ``verified, confidence, reason`` with array
higher-order functions only — the per-row loops of the reference become Catalyst
expressions, evaluated where the rows already are (no join, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalogue as cat
from ..functions.text import type_alias

SPAN = "struct<text:string,score:double>"
TOKEN = "struct<label:string,tok_start:int,tok_end:int,prob:double>"
NOT_FOUND = "Entity value not found in context"
NOT_DETECTED_TOKENS = "Not detected as PHI by model"
NOT_DETECTED_SPANS = "Not detected by span model"


def fmt2(x: Column) -> Column:
    """``{x:.2f}`` (HALF_UP on the shortest decimal form)."""
    return F.format_string("%.2f", x)


def softmax(logits: Column) -> Column:
    """I-22: softmax over an ``array<double>`` (shifted by the max; same value)."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


def logit_decision(logits: Column, entity_type: Column, positive_class: int = 1) -> Column:
    """J-09: class ``positive_class`` probability, ``>= 0.5`` verifies, banded reasons (I-27/28)."""
    conf = F.element_at(softmax(logits), positive_class + 1)
    t = F.concat(F.lit(" ("), entity_type, F.lit(")"))
    reason = (F.when(conf >= 0.5, F.when(conf > 0.9, F.concat(F.lit("High confidence PII detection"), t))
                     .when(conf > 0.7, F.concat(F.lit("Likely PII"), t))
                     .otherwise(F.concat(F.lit("Possible PII"), t)))
              .otherwise(F.when(conf < 0.3, F.concat(F.lit("Low confidence, likely false positive"), t))
                         .otherwise(F.concat(F.lit("Uncertain, may be false positive"), t))))
    return F.struct((conf >= 0.5).alias("verified"), F.round(conf, 4).alias("confidence"),
                    reason.alias("reason"))


def argmax(a: Column) -> Column:
    """I-23: 0-based index of the first maximum."""
    return F.array_position(a, F.array_max(a)) - 1


def span_decision(spans: Column, value: Column) -> Column:
    """J-10: first matching span with score >= 0.5, else first with score >= 0.3 (D-04)."""
    v = F.lower(value)
    match = F.filter(spans, lambda s: F.contains(F.lower(s.text), v) | F.contains(v, F.lower(s.text)))
    hi = F.try_element_at(F.filter(match, lambda s: s.score >= 0.5), F.lit(1))
    lo = F.try_element_at(F.filter(match, lambda s: s.score >= 0.3), F.lit(1))
    return F.struct(
        (hi.isNotNull() | lo.isNotNull()).alias("verified"),
        F.coalesce(hi.score, lo.score, F.lit(0.5)).alias("confidence"),
        F.when(hi.isNotNull(), F.concat(F.lit("Detected by span model with confidence "), fmt2(hi.score)))
         .when(lo.isNotNull(), F.concat(F.lit("Detected with low confidence "), fmt2(lo.score)))
         .otherwise(F.lit(NOT_DETECTED_SPANS)).alias("reason"))


def scorer_label(entity_type: Column) -> Column:
    """I-20: entity type -> label the span scorer is asked for."""
    return type_alias(entity_type, cat.TYPE_ALIASES)


def token_decision(tokens: Column, text: Column, value: Column) -> Column:
    """J-11: locate the value (D-06), keep overlapping non-O tokens (D-05), average their
    probabilities (E-14) and name the most frequent label (E-15; ties -> smallest label)."""
    start = F.instr(F.lower(text), F.lower(value)) - 1
    end = start + F.length(value)
    hit = F.filter(tokens, lambda t: (t.tok_start < end) & (t.tok_end > start) & (t.label != "O"))
    labels = F.transform(hit, lambda t: t.label)
    n = F.size(hit)
    avg = F.aggregate(hit, F.lit(0.0), lambda a, t: a + t.prob) / n
    count = lambda lab: F.size(F.filter(labels, lambda x: x == lab))
    maxc = F.array_max(F.transform(F.array_distinct(labels), count))
    top = F.try_element_at(F.filter(F.array_sort(F.array_distinct(labels)), lambda lab: count(lab) == maxc),
                           F.lit(1))
    found = start >= 0
    return F.struct(
        (found & (n > 0)).alias("verified"),
        F.when(~found, F.lit(0.5)).when(n > 0, avg).otherwise(F.lit(0.6)).alias("confidence"),
        F.when(~found, F.lit(NOT_FOUND))
         .when(n > 0, F.concat(F.lit("Detected as "), top, F.lit(" with confidence "), fmt2(avg)))
         .otherwise(F.lit(NOT_DETECTED_TOKENS)).alias("reason"))
