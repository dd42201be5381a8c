"""Rule verifier (J-03 false-positive guards, J-04 three-test decision).

The rule table in ``catalogue.VERIFY_RULES`` is compiled into plain ``CASE WHEN ... rlike``
Columns, so verification is a per-row projection: no UDF, no join, no shuffle. A guard hit
makes all three tests false; otherwise each test is the outcome of its first matching rule
or NULL (uncertain). ``verified = NOT (own IS FALSE AND spec IS FALSE AND ctx IS FALSE)`` —
any positive or uncertain test keeps the element, as the reference's prompt demands.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalogue as cat
from .detect import CONTEXT_CHARS, _before
from .rows import generator_input

DEFAULT_WINDOW = 60
REASON_ALL_NEGATIVE = "All three tests negative"
REASON_UNCERTAIN = "Uncertain on all tests; verified to protect privacy"


def luhn_ok(value: Column) -> Column:
    """Card checksum over the digits of ``value`` (all Catalyst higher-order functions)."""
    d = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def step(acc, i):
        digit = F.substring(d, i, 1).cast("int")
        doubled = F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when(i % 2 == 1, digit).otherwise(doubled)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)
    return (F.length(d) > 0) & (total % 10 == 0)


def narrow_context(context: Column, ctx_offset: Column, value: Column, window: int) -> Column:
    """Cut a detection context down to ``window`` characters on each side."""
    start = F.greatest(ctx_offset - window, F.lit(0))
    return F.substring(context, start + 1, ctx_offset - start + F.length(value) + window)


def _rule_hit(scope: str, pattern: str, value: Column, context: Column,
              after: Column | None) -> Column:
    if scope == "after":
        return (after if after is not None else F.lit("")).rlike(pattern)
    if scope == "value":
        return value.rlike(pattern)
    if scope == "context":
        return context.rlike(pattern)
    if scope == "context_absent":
        return ~context.rlike(pattern)
    if scope == "luhn_fail":
        return ~luhn_ok(value)
    raise ValueError(scope)


def _first_match(rules, etype: Column, value: Column, context: Column, pick,
                 after: Column | None = None) -> Column:
    expr = None
    for r in rules:
        cond = (etype == r[0]) & _rule_hit(r[2], r[3], value, context, after)
        expr = F.when(cond, pick(r)) if expr is None else expr.when(cond, pick(r))
    return expr if expr is not None else F.lit(None)


def rule_raw(etype: Column, value: Column, context: Column, rules=None,
             after: Column | None = None) -> Column:
    """Phase 1 — every regex chain evaluated once: struct(guard, own, spec, ctx) where guard
    is the first guard reason (or NULL) and each test is struct(outcome, reason) of its first
    matching rule (or NULL = uncertain)."""
    rules = rules or cat.VERIFY_RULES
    guards = [r for r in rules if r[1] == "guard"]
    fields = [_first_match(guards, etype, value, context, lambda r: F.lit(r[5]), after)
              .cast("string").alias("guard")]
    for t in cat.TESTS:
        tr = [r for r in rules if r[1] == t]
        hit = _first_match(tr, etype, value, context,
                           lambda r: F.struct(F.lit(r[4]).alias("outcome"), F.lit(r[5]).alias("reason")),
                           after)
        fields.append(hit.cast("struct<outcome:boolean,reason:string>").alias(t))
    return F.struct(*fields)


def rule_decide(raw: Column) -> dict[str, Column]:
    """Phase 2 — cheap: tri-state tests, verdict, confidence and reason from ``rule_raw``."""
    guard = raw["guard"]
    tests = {t: F.when(guard.isNotNull(), F.lit(False)).otherwise(raw[t]["outcome"]) for t in cat.TESTS}
    all_false = None
    for t in cat.TESTS:
        f = ~F.coalesce(tests[t], F.lit(True))
        all_false = f if all_false is None else all_false & f
    verified = ~all_false
    n_true = sum((F.coalesce(tests[t], F.lit(False)).cast("int") for t in cat.TESTS), F.lit(0))
    confidence = (F.when(guard.isNotNull(), F.lit(0.1)).when(~verified, F.lit(0.2))
                  .when(n_true == 0, F.lit(0.5)).when(n_true == 1, F.lit(0.65))
                  .when(n_true == 2, F.lit(0.8)).otherwise(F.lit(0.95)))
    reason = F.when(guard.isNotNull(), guard).when(~verified, F.lit(REASON_ALL_NEGATIVE))
    for t in cat.TESTS:
        reason = reason.when(tests[t], F.concat(F.lit(cat.TEST_NAMES[t] + ": "), raw[t]["reason"]))
    reason = reason.otherwise(F.lit(REASON_UNCERTAIN))
    return {"guard_reason": guard, **tests, "verified": verified,
            "confidence": confidence, "reason": reason}


def rule_columns(etype: Column, value: Column, context: Column, rules=None,
                 after: Column | None = None) -> dict[str, Column]:
    """Columns for guard reason, the three tri-state tests, verdict, confidence and reason."""
    return rule_decide(rule_raw(etype, value, context, rules, after))


def verify_candidates(cands: DataFrame, window: int = DEFAULT_WINDOW, rules=None,
                      context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """J-03/J-04 on detected candidates (output of ``detect_candidates``), each occurrence in its own context.

    Adds ``own, spec, ctx, guard_reason, verified, confidence, reason``. ``window`` must not exceed
    the ``context_chars`` that the candidates were detected with.
    """
    if window > context_chars:
        raise ValueError(f"window {window} exceeds the candidates' context of {context_chars} characters")
    raw, cols = _verify_plan(window, None if rules is None else tuple(tuple(r) for r in rules))
    staged = cands.withColumn("_rule_raw", raw)   # regexes once per row, decisions read it
    return staged.select(*cands.columns, *[c.alias(k) for k, c in cols])


def verify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = DEFAULT_WINDOW,
                     rules=None, **detection) -> DataFrame:
    """Detect and verify in one call; contexts are as wide as ``window`` asks."""
    from .detect import detect_candidates
    wide = max(window, detection.pop("context_chars", CONTEXT_CHARS))
    return verify_candidates(detect_candidates(docs, id_col, text_col, context_chars=wide, **detection), window, rules, wide)


def value_verdicts(verdicts: DataFrame, keys=("doc_id", "entity_type", "label", "entity_value")) -> DataFrame:
    """One row per value: verified if any of its occurrences is (privacy first).

    ``reason`` and ``first_pos`` are those of the first occurrence with that verdict; counts say how many
    occurrences there are and how many are verified. Aggregated before its shuffle, so a value
    repeated any number of times travels as one row per task.
    """
    best = F.min(F.struct((~F.col("verified")).alias("no"), F.col("pos"), F.col("reason"))).alias("_best")
    return verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.count_if("verified").alias("n_verified"), best).select(
        *keys, "n_occurrences", "n_verified", (~F.col("_best.no")).alias("verified"),
        F.col("_best.pos").alias("first_pos"), F.col("_best.reason").alias("reason"))


@lru_cache(maxsize=32)
def _verify_plan(window: int, rules_key):
    """Column trees of ``verify_candidates`` (built once per window / rule set)."""
    rules = list(rules_key) if rules_key else None
    ctx = narrow_context(F.col("context"), F.col("ctx_offset"), F.col("entity_value"), window)
    raw = rule_raw(F.col("entity_type"), F.col("entity_value"), ctx, rules,
                   after_value(F.col("context"), F.col("ctx_offset"), F.col("entity_value"), window))
    return raw, tuple(rule_decide(F.col("_rule_raw")).items())


def after_value(context: Column, ctx_offset: Column, value: Column, window: int) -> Column:
    """The ``window`` characters right after the value inside its context."""
    return F.substring(context, ctx_offset + F.length(value) + 1, F.lit(window))


_PLACE = "array<struct<pos:bigint,context:string,ctx_offset:int>>"


def _with_places(records: DataFrame, text_col: str, value_col: str, context_chars: int) -> DataFrame:
    """``records`` with ``_places``: position and context of every occurrence of the value (pos 0: none)."""
    text, value = F.col(text_col), F.col(value_col)
    held: list[dict[str, Column]] = []

    def ref(name: str, expr: Column) -> Column:
        held.append({name: expr})
        return F.col(name)
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    gaps = ref("_gaps", F.when(F.length(value) > 0, F.split(text, quoted, -1)))
    steps = ref("_steps", F.transform(gaps, lambda g: F.length(g) + F.length(value)))
    before = _before(steps, F.lit(0), lambda x, y: x + y, ref, "_sums")
    found = F.when(F.size(gaps) > 1, F.transform(
        F.sequence(F.lit(0), F.size(gaps) - 2), lambda i: before(i) + F.length(F.get(gaps, i)) + 1)).otherwise(F.array(F.lit(0)))

    def place(pos: Column) -> Column:
        start = F.greatest(pos - context_chars, F.lit(1))
        return F.struct(pos.cast("bigint").alias("pos"),
                        F.substring(text, start, pos - start + F.length(value) + context_chars).alias("context"),
                        (pos - start).cast("int").alias("ctx_offset"))
    places = F.transform(ref("_found", found), place).cast(_PLACE)
    out = records
    for level in held:
        out = out.withColumns(level)
    return out.withColumn("_places", places).drop(*[n for level in held for n in level])


def entity_candidates(records: DataFrame, text_col: str = "input", type_col: str = "entityType",
                      value_col: str = "entityValue", context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``EntityRecord`` rows (value given by an upstream detector) as verifier candidates.

    One row per occurrence of the value in the text; ``pos`` is 0 where it does not occur.
    """
    rows = _with_places(records, text_col, value_col, context_chars)
    return rows.select(*records.columns, F.col(type_col).alias("entity_type"), F.col(value_col).alias("entity_value"),
                       F.inline(generator_input("_places")))


def verify_entities(records: DataFrame, text_col: str = "input", type_col: str = "entityType",
                    value_col: str = "entityValue", window: int = DEFAULT_WINDOW, rules=None) -> DataFrame:
    """J-03/J-04 on ``EntityRecord`` rows: one verdict per record, verified if any occurrence is.

    Adds ``pos, context, ctx_offset`` of the first occurrence with that verdict, then the columns of
    ``verify_candidates``. Occurrences are judged inside the record's row: no shuffle.
    """
    rows = _with_places(records, text_col, value_col, max(window, CONTEXT_CHARS))
    etype, value = F.col(type_col), F.col(value_col)
    raws = F.transform("_places", lambda c: F.struct(
        c.pos.alias("pos"), c.context.alias("context"), c.ctx_offset.alias("ctx_offset"),
        rule_raw(etype, value, narrow_context(c.context, c.ctx_offset, value, window), rules,
                 after_value(c.context, c.ctx_offset, value, window)).alias("r")))
    verdicts = F.transform("_raws", lambda x: F.struct(
        (~rule_decide(x.r)["verified"]).alias("no"), x.pos.alias("pos"), x.context.alias("context"),
        x.ctx_offset.alias("ctx_offset"), *[c.alias(k) for k, c in rule_decide(x.r).items()]))
    keep = [F.col(f"`{c}`") for c in records.columns]
    names = ["guard_reason", *cat.TESTS, "verified", "confidence", "reason"]
    return (rows.select(*keep, raws.alias("_raws")).select(*keep, verdicts.alias("_verdicts"))
            .select(*keep, F.array_min("_verdicts").alias("_best"))
            .select(*keep, etype.alias("entity_type"), value.alias("entity_value"),
                    *[F.col(f"_best.{c}") for c in ["pos", "context", "ctx_offset", *names]]))


def confusion_metrics(df: DataFrame, pred_col: str = "verified", truth_col: str = "is_true_positive",
                      by: str = "entityType") -> DataFrame:
    """E-12: tp/fp/fn/tn, precision, recall, F1, false-positive rate; ROLLUP adds a total row.

    Ratios are NULL when their denominator is 0; F1 uses the count form 2tp/(2tp+fp+fn).
    """
    p, t = F.col(pred_col), F.col(truth_col)
    agg = df.rollup(by).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(by, "tp", "fp", "fn", "tn",
                      d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"),
                      d(2 * tp, 2 * tp + fp + fn).alias("f1"), d(fp, fp + tn).alias("fpr"))


def match_outputs(inputs: DataFrame, outputs: DataFrame, key: str = "recordId",
                  order_col: str | None = None, how: str = "inner") -> DataFrame:
    """D-01/D-02: join inputs to outputs on ``key``; duplicates keep the last row per side.

    ``how='left_anti'`` lists inputs that have no output. Deduplication is a ``max_by`` per
    key (partial aggregation), never a collect.
    """
    def last(df):
        cols = [c for c in df.columns if c != key]
        if not cols:
            return df.dropDuplicates([key])
        own = F.struct(*[F.col(f"`{c}`") for c in cols])
        # without an order the row whose JSON text is largest stays, the same at any partitioning
        order = F.struct(F.col(order_col), F.to_json(own)) if order_col in df.columns else F.to_json(own)
        return df.groupBy(key).agg(F.max_by(own, order).alias("_row")).select(key, "_row.*")
    return last(inputs).join(last(outputs), key, how)


def verification_summary(verdicts: DataFrame, by: str = "entity_type") -> DataFrame:
    """E-01/E-02 per group: total, verified, rejected, verification_rate (0 when empty)."""
    return (verdicts.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("verified").alias("verified"),
        F.count_if(~F.col("verified")).alias("rejected"))
        .withColumn("verification_rate", F.coalesce(
            F.try_divide(F.col("verified").cast("double"), F.col("total")), F.lit(0.0)))
        .orderBy(by))


def verify_labels(records: DataFrame, candidate_verdicts: DataFrame, id_col: str = "recordId",
                  text_col: str = "input", labels_col: str = "PIIs") -> DataFrame:
    """Label-level verdicts for ``DetectedRecord`` rows (one row per record and label).

    A label is verified when any located value of it is verified (privacy first). Labels the
    detector cannot locate fall back to whole-text guards (ticket ids, product names ...),
    and are verified when no guard fires. Candidate verdicts are pre-aggregated per
    (record, label) before the equi-join, so the join is one-to-one.
    """
    per_label = (candidate_verdicts.groupBy(id_col, "label").agg(
        F.bool_or("verified").alias("any_verified"),
        F.min_by("reason", F.struct(~F.col("verified"), F.col("pos"))).alias("v_reason"),
        F.min_by("reason", F.col("pos")).alias("first_reason")))
    exploded = records.select(id_col, text_col,
                              F.posexplode(generator_input(labels_col)).alias("label_pos", "label"))
    guard = None
    for label, pattern, reason in cat.LABEL_GUARDS:
        cond = (F.col("label") == label) & F.col(text_col).rlike(pattern)
        guard = F.when(cond, F.lit(reason)) if guard is None else guard.when(cond, F.lit(reason))
    joined = exploded.join(per_label, [id_col, "label"], "left")
    located = F.col("any_verified").isNotNull()
    return joined.select(
        id_col, "label_pos", F.col("label").alias("pii"),
        F.when(located, F.col("any_verified")).otherwise(guard.isNull()).alias("verified"),
        F.when(located & F.col("any_verified"), F.col("v_reason"))
         .when(located, F.col("first_reason"))
         .when(guard.isNotNull(), guard)
         .otherwise(F.lit("Value not located; " + REASON_UNCERTAIN.lower())).alias("reason"))


def _label_guard(label: Column, text: Column) -> Column:
    out = None
    for lab, pattern, reason in cat.LABEL_GUARDS:
        cond = (label == lab) & text.rlike(pattern)
        out = F.when(cond, F.lit(reason)) if out is None else out.when(cond, F.lit(reason))
    return out


def verify_labels_in_row(df: DataFrame, text_col: str = "input", labels_col: str = "PIIs",
                         window: int = DEFAULT_WINDOW) -> DataFrame:
    """``verify_labels`` computed inside each record's row (no join, one pass): detection,
    rule verdicts per located value, whole-text guards for labels that cannot be located,
    then one output row per (record, label) with ``label_pos, pii, verified, reason``.
    All other columns of ``df`` are carried through."""
    from .detect import detect_arrays
    from .rows import generator_input
    keep = [c for c in df.columns if c != labels_col]
    arr = detect_arrays(df, text_col, labels_out="_detected")
    raws, decided, items = _labels_plan(text_col, labels_col, window)
    staged = arr.select(*keep, labels_col, raws.alias("_raws"))
    staged = staged.select(*keep, labels_col, decided.alias("_dec"))
    return staged.select(*keep, F.inline(generator_input(items)))


@lru_cache(maxsize=32)
def _labels_plan(text_col: str, labels_col: str, window: int):
    """Column trees of ``verify_labels_in_row`` (built once per parameter set)."""
    raws = F.transform("candidates", lambda c: F.struct(
        c.label.alias("label"), c.pos.alias("pos"),
        rule_raw(c.entity_type, c.entity_value,
                 narrow_context(c.context, c.ctx_offset, c.entity_value, window),
                 after=after_value(c.context, c.ctx_offset, c.entity_value, window)).alias("r")))

    def decide(x):
        d = rule_decide(x.r)
        return F.struct(x.label.alias("label"), x.pos.alias("pos"),
                        d["verified"].alias("verified"), d["reason"].alias("reason"))

    text = F.col(text_col)

    def item(lab, pos):
        ml = F.filter("_dec", lambda x: x.label == lab)
        located = F.size(ml) > 0
        any_ok = F.exists(ml, lambda x: x.verified)
        first = F.element_at(F.array_sort(F.transform(ml, lambda x: F.struct(
            (~x.verified).alias("k1"), x.pos.alias("k2"), x.reason.alias("reason")))), 1)
        guard = _label_guard(lab, text)
        return F.struct(
            pos.alias("label_pos"), lab.alias("pii"),
            F.when(located, any_ok).otherwise(guard.isNull()).alias("verified"),
            F.when(located, first.reason).when(guard.isNotNull(), guard)
             .otherwise(F.lit("Value not located; " + REASON_UNCERTAIN.lower())).alias("reason"))

    return raws, F.transform("_raws", decide), F.transform(labels_col, item)
