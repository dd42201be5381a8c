"""Reply parsing as a table job (P-01 ... P-15), plus a ``parse_path`` column.

Each branch of the reference's per-row parser becomes a Column expression over the reply
and the detected labels; a row's ``parse_path`` names the branch it took so fail-open and
fail-closed fallbacks can be counted and overridden.

JSON strictness: Spark's parsers accept text after the first value, so a slice is
validated by parsing it wrapped in ``[ ... ]`` — a trailing second value then fails, as it
does for Python's ``json.loads``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogue as cat
from ..functions.text import contains_any, py_strip, startswith_any, word_set

ITEM = "struct<pii:string,verified:boolean,reason:string>"
ITEMS = f"array<{ITEM}>"


def _json_slice(s: Column) -> Column:
    """Text from the first '{' to the last '}' (inclusive), or NULL when there is none."""
    start = F.instr(s, "{")
    end = F.length(s) - F.instr(F.reverse(s), "}") + 1  # 1-based index of the last '}'
    ok = (start > 0) & (F.instr(s, "}") > 0) & (end > start)
    return F.when(ok, F.substring(s, start, end - start + 1))


def strict_json(s: Column) -> Column:
    """Parse ``s`` as exactly one JSON value; NULL when invalid (variant of a 1-item array).

    The wrapping alone would also accept ``a, b``, so the array must have one item."""
    wrapped = F.concat(F.lit("["), s, F.lit("]"))
    return F.when(F.json_array_length(wrapped) == 1, F.try_parse_json(wrapped))


def _all(labels: Column, verified: bool, reason: str | Column) -> Column:
    r = reason if isinstance(reason, Column) else F.lit(reason)
    return F.transform(labels, lambda d: F.struct(
        d.alias("pii"), F.lit(verified).alias("verified"), r.alias("reason")))


# ----------------------------------------------------------------------------- single entity
def _inline(name: str, expr: Column) -> Column:
    return expr


def parse_single(reply: Column, ref=_inline) -> Column:
    """P-01 ... P-03: struct(verified, confidence, reason, parse_path).

    ``ref(name, expr)`` lets ``staged`` materialise intermediate values once per row."""
    sl = ref("_sl", _json_slice(reply))
    v = ref("_v", strict_json(sl))
    obj = ref("_obj", F.try_variant_get(v, "$[0]", "variant"))
    has = lambda k: F.try_variant_get(obj, f"$.{k}", "variant").isNotNull()
    ver = F.try_variant_get(obj, "$.verified", "boolean")
    conf = F.try_variant_get(obj, "$.confidence", "double")
    rsn = F.try_variant_get(obj, "$.reason", "string")
    is_obj = F.startswith(F.schema_of_variant(F.coalesce(obj, F.parse_json(F.lit("null")))),
                          F.lit("OBJECT"))
    # a present key holding an unusable value (e.g. non-numeric confidence) is an error
    bad_conf = has("confidence") & conf.isNull()
    low = F.lower(reply)
    text_yes = F.contains(low, F.lit("true")) | F.contains(low, F.lit("yes"))
    path = ref("_path", F.when(sl.isNull(), F.lit("P-02"))
               .when(v.isNull() | ~is_obj | bad_conf, F.lit("P-03"))
               .otherwise(F.lit("P-01")))
    return F.struct(
        F.when(path == "P-01", F.when(has("verified"), ver).otherwise(F.lit(True)))
         .when(path == "P-02", text_yes).otherwise(F.lit(True)).alias("verified"),
        F.when(path == "P-01", F.when(has("confidence"), conf).otherwise(F.lit(0.5)))
         .when(path == "P-02", F.when(text_yes, F.lit(0.7)).otherwise(F.lit(0.6)))
         .otherwise(F.lit(0.5)).alias("confidence"),
        F.when(path == "P-01", F.when(has("reason"), rsn).otherwise(F.lit(cat.REASON_SINGLE_DEFAULT)))
         .when(path == "P-02", F.lit(cat.REASON_SINGLE_TEXT))
         .otherwise(F.lit("Parse error: invalid JSON")).alias("reason"),
        path.alias("parse_path"))


# ----------------------------------------------------------------------------- reasoning mode
def strip_fence(s: Column) -> Column:
    """I-11: drop an opening ``` line and a closing ``` line, then strip."""
    lines = F.split(s, "\n", -1)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    last = F.try_element_at(body, F.lit(-1))
    body = F.when((F.size(body) > 0) & (py_strip(last) == "```"),
                  F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    return F.when(F.startswith(s, F.lit("```")), py_strip(F.array_join(body, "\n"))).otherwise(s)


def parse_reasoning(reply: Column, detected: Column, ref=_inline) -> Column:
    """P-04 ... P-09: struct(items array<struct<pii,verified,reason>>, parse_path)."""
    r0 = ref("_r0", py_strip(F.coalesce(reply, F.lit(""))))
    rc = ref("_rc", strip_fence(r0))
    sl = ref("_sl", _json_slice(rc))
    fixed = F.replace(F.replace(sl, F.lit(": True"), F.lit(": true")),
                      F.lit(": False"), F.lit(": false"))
    v = ref("_v", strict_json(fixed))
    results = ref("_res", F.try_variant_get(v, "$[0].results", "variant"))
    is_list = F.startswith(F.schema_of_variant(F.coalesce(results, F.parse_json(F.lit("null")))),
                           F.lit("ARRAY"))
    # items one by one: a non-object item becomes NULL and is dropped, the rest survive
    items = F.filter(F.transform(F.try_variant_get(results, "$", "array<variant>"),
                                 lambda x: F.try_variant_get(x, "$", ITEM)),
                     lambda x: x.isNotNull())
    path = ref("_path", F.when((rc == "") | (rc == "```"), F.lit("P-04"))
               .when(sl.isNull(), F.lit("P-07"))
               .when(v.isNull(), F.lit("P-08"))
               .when(is_list, F.lit("P-05"))
               .otherwise(F.lit("P-06")))
    out = (F.when(path == "P-04", _all(detected, False, cat.REASON_EMPTY_REPLY))
           .when(path == "P-07", _all(detected, False, cat.REASON_NO_JSON))
           .when(path == "P-08", _all(detected, True, cat.REASON_DECODE_FAILED))
           .when(path == "P-05", items)
           .otherwise(_all(detected, False, cat.REASON_BAD_STRUCTURE)))
    return F.struct(out.cast(ITEMS).alias("items"), path.alias("parse_path"))


def invented_labels(items: Column, detected: Column) -> Column:
    """P-05b invariant: reasoning results are returned unvalidated; count items naming a
    label the detector never reported. Apply to a materialised items column."""
    return F.size(F.filter(items, lambda x: ~F.coalesce(F.array_contains(detected, x.pii), F.lit(False))))


# ----------------------------------------------------------------------------- simple mode
def _stop_match(p: Column, d: Column) -> Column:
    lp, ld = F.lower(p), F.lower(d)
    return (lp == ld) | F.contains(ld, lp) | F.contains(lp, ld)


def fuzzy_match(part: Column, detected: Column) -> Column:
    """D-07: first exact/substring match in list order, else the LAST word-overlap match."""
    words = word_set(F.lower(part))
    stop = F.try_element_at(F.filter(detected, lambda d: _stop_match(part, d)), F.lit(1))
    overlap = F.try_element_at(
        F.filter(detected, lambda d: F.arrays_overlap(words, word_set(F.lower(d)))), F.lit(-1))
    return F.coalesce(stop, overlap)


def parse_simple(reply: Column, detected: Column, ref=_inline) -> Column:
    """P-10 ... P-15: struct(verified array<string>, parse_path, unmatched_parts)."""
    raw = F.coalesce(reply, F.lit(""))
    r0 = ref("_r0", py_strip(raw))
    # P-10: after a garbage prefix, jump to the first detected label found past index 0
    hit = F.try_element_at(F.filter(detected, lambda d: F.instr(r0, d) > 1), F.lit(1))
    r1 = ref("_r1", F.when(startswith_any(r0, cat.GARBAGE_PREFIXES) & hit.isNotNull(),
                           F.substring(r0, F.instr(r0, hit), F.length(r0))).otherwise(r0))
    none = F.contains(F.upper(F.substring(r1, 1, 20)), F.lit("NONE"))
    # P-12: split, strip, drop empty/NONE, keep first line, drop sentences and stop words
    parts = F.filter(F.transform(F.split(r1, ",", -1), lambda p: py_strip(p)),
                     lambda p: (p != "") & (F.upper(p) != "NONE"))
    parts = F.transform(parts, lambda p: F.when(F.instr(p, "\n") > 0,
                                                py_strip(F.substring_index(p, "\n", 1))).otherwise(p))
    parts = ref("_parts", F.filter(parts, lambda p: (F.length(p) < 100) & ~contains_any(p, cat.STOP_WORDS)))
    # P-13: fuzzy match each part, keep first occurrences in order
    matched = F.array_distinct(F.filter(F.transform(parts, lambda p: fuzzy_match(p, detected)),
                                        lambda x: x.isNotNull() & (x != "")))
    # P-14: JSON fallback on the original reply
    sl = ref("_sl", _json_slice(raw))
    v = ref("_v", strict_json(sl))
    vp = ref("_vp", F.try_variant_get(v, "$[0].verified_piis", "variant"))
    vp_list = F.startswith(F.schema_of_variant(F.coalesce(vp, F.parse_json(F.lit("null")))),
                           F.lit("ARRAY"))
    path = ref("_path", F.when(none, F.lit("P-11"))
            .when(F.size(parts) > 0, F.lit("P-13"))
            .when(sl.isNotNull() & v.isNull(), F.lit("P-15"))
            .when(vp_list, F.lit("P-14"))
            .otherwise(F.lit("P-15")))
    out = (F.when(path == "P-11", F.array().cast("array<string>"))
           .when(path == "P-13", matched)
           .when(path == "P-14", F.try_variant_get(vp, "$", "array<string>"))
           .otherwise(detected))
    unmatched = F.filter(parts, lambda p: fuzzy_match(p, detected).isNull())   # H-05
    return F.struct(out.alias("verified"), path.alias("parse_path"),
                    F.when(path == "P-13", unmatched).otherwise(F.array().cast("array<string>"))
                    .alias("unmatched_parts"))


def label_set_agreement(expected: Column, got: Column) -> Column:
    """E-26: per-record agreement of two label sets: struct(tp, fp, fn)."""
    e, g = F.array_distinct(expected), F.array_distinct(got)
    return F.struct(F.size(F.array_intersect(e, g)).alias("tp"),
                    F.size(F.array_except(g, e)).alias("fp"),
                    F.size(F.array_except(e, g)).alias("fn"))


def parse_replies(df: DataFrame, mode: str, reply_col: str = "raw_response",
                  detected_col: str = "detected_piis") -> DataFrame:
    """Parse a reply table in ``simple`` or ``reasoning`` mode; adds the parsed columns."""
    if mode == "simple":
        return staged(df, parse_simple, reply_col, detected_col, out="_p").select(
            "*", "_p.verified", "_p.parse_path").drop("_p")
    if mode == "reasoning":
        out = staged(df, parse_reasoning, reply_col, detected_col, out="_p").select(
            "*", F.col("_p.items").alias("verified_piis"), "_p.parse_path").drop("_p")
        return out.withColumn("n_invented", invented_labels(F.col("verified_piis"), F.col(detected_col)))
    raise ValueError(mode)


def verify_records(records: DataFrame, factory, model: str, mode: str = "simple") -> DataFrame:
    """Batch verification of ``(recordId, input, PIIs)`` rows as result records, in one of the reply modes.

    Records without labels are not scored: they get no verdicts and latency 0.0 (C-03). The
    stream (L-01) and batch jobs share this function.
    """
    from .scorer import score_with
    kind = ITEMS if mode == "reasoning" else "array<string>"
    rows = records.select("recordId", "input", F.coalesce("PIIs", F.array().cast("array<string>")).alias("detected_piis"))
    scored = parse_replies(score_with(rows.where(F.size("detected_piis") > 0), factory), mode)
    found = F.col("verified_piis" if mode == "reasoning" else "verified").cast(kind).alias("verified_piis")
    cols = ["recordId", "input", "detected_piis"]
    short = rows.where(F.size("detected_piis") == 0).select(
        *cols, F.array().cast(kind).alias("verified_piis"), F.lit(0.0).alias("latency_ms"))
    return (scored.select(*cols, found, F.round("latency_ms", 2).alias("latency_ms")).unionByName(short)
            .withColumn("model", F.lit(model)))


def staged(df: DataFrame, parser, *cols: str, out: str = "p") -> DataFrame:
    """Run ``parser`` (parse_single / parse_simple / parse_reasoning) over columns of
    ``df`` with its intermediate values (stripped text, JSON slice, parsed VARIANT, parts)
    materialised once per row as helper columns, then dropped; adds struct column ``out``."""
    stages: list[tuple[str, Column]] = []

    def ref(name, expr):
        stages.append((name, expr))
        return F.col(name)

    result = parser(*[F.col(c) for c in cols], ref=ref)
    for name, expr in stages:
        df = df.withColumn(name, expr)
    return df.withColumn(out, result).drop(*[n for n, _ in stages])
