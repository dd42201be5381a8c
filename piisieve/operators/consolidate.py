"""Verifier comparison: long verdict table, batch results, consolidation pivot and reports.

Covers C-02/C-03/E-13/H-06 (batch result rows), C-05/C-06/I-31 (reading struct items of
``verified_piis``), E-16 ... E-22 (per-record PII counts, model order, first-seen input,
last-seen verdict, pivot, consensus, rejection rates), C-13 (YES/NO/N/A cells), I-13
(200-char input) and D-08 (N-way outer alignment through the pivot).

All comparison work is keyed by (record, pii): the pivot is one ``groupBy`` with explicit
model values (no extra job to discover them) and the input text is truncated map-side,
before any shuffle, so long documents never travel.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalogue as cat
from ..functions.text import truncate_text
from .rows import generator_input
from .verify import after_value, narrow_context, rule_decide, rule_raw

VERDICT_ITEM = "struct<pii:string,verified:boolean,reason:string>"
REASON_NO_GUARD = "No false-positive guard fired"


@dataclass(frozen=True)
class RuleModel:
    """A rule-verifier variant used as one "model" in comparisons."""
    name: str
    window: int
    mode: str = "three_tests"  # or "guards_only"
    types: tuple[str, ...] | None = None  # entity types it handles; None = all


RULE_MODELS = (
    RuleModel("rules_strict_reasoning", 30),
    RuleModel("rules_balanced_reasoning", 60),
    RuleModel("rules_privacy_first_reasoning", 120, "guards_only", ("EMAIL", "PHONE", "IPV4", "CARD")),
)


def _model_raw(m: RuleModel, c: Column | None = None) -> Column:
    """Phase-1 rule evaluation of model ``m`` for a candidate (columns, or the struct ``c``);
    NULL when the model does not handle the entity type."""
    get = (lambda f: F.col(f)) if c is None else (lambda f: c[f])
    ctx = narrow_context(get("context"), get("ctx_offset"), get("entity_value"), m.window)
    after = after_value(get("context"), get("ctx_offset"), get("entity_value"), m.window)
    raw = rule_raw(get("entity_type"), get("entity_value"), ctx, after=after)
    handles = F.lit(True) if m.types is None else get("entity_type").isin(*m.types)
    return F.when(handles, raw)


def _model_decision(m: RuleModel, raw: Column) -> Column:
    """Phase 2: struct(verified, reason) of model ``m`` from its raw evaluation."""
    if m.mode == "guards_only":
        verified = raw["guard"].isNull()
        reason = F.coalesce(raw["guard"], F.lit(REASON_NO_GUARD))
    else:
        cols = rule_decide(raw)
        verified, reason = cols["verified"], cols["reason"]
    return F.when(raw.isNotNull(), F.struct(verified.alias("verified"), reason.alias("reason")))


def _model_verdict(m: RuleModel, c: Column | None = None) -> Column:
    """Verdict struct(model, verified, reason) of model ``m``; NULL when not handled."""
    d = _model_decision(m, _model_raw(m, c))
    return F.when(d.isNotNull(), F.struct(F.lit(m.name).alias("model"), d["verified"].alias("verified"),
                                          d["reason"].alias("reason")))


def _row_items(i: int, verdicts: Column, labels: Column) -> Column:
    """Model ``i``'s ``verified_piis`` for one document from the staged per-candidate
    verdicts: per label (sorted), verified if any of its values is, with the reason of the
    earliest value carrying that verdict; labels the model does not handle are left out."""
    key = f"v{i}"
    vs = F.filter(verdicts, lambda x: x[key].isNotNull())

    def item(lab):
        ml = F.filter(vs, lambda x: x.label == lab)
        ranked = F.array_sort(F.transform(ml, lambda x: F.struct(
            (~x[key].verified).alias("k1"), x.pos.alias("k2"), x[key].reason.alias("reason"))))
        return F.when(F.size(ml) > 0, F.struct(
            lab.alias("pii"), F.exists(ml, lambda x: x[key].verified).alias("verified"),
            F.element_at(ranked, 1).reason.alias("reason")))

    return F.filter(F.transform(labels, item), lambda x: x.isNotNull())


@lru_cache(maxsize=32)
def _batch_plan(models: tuple, candidates_col: str, labels_col: str):
    """The (large, immutable) Column trees of ``batch_results_in_row``, built once."""
    raws = F.transform(F.col(candidates_col), lambda c: F.struct(
        c.label.alias("label"), c.pos.alias("pos"),
        *[_model_raw(m, c).alias(f"r{i}") for i, m in enumerate(models)]))
    verdicts = F.transform(F.col("_raws"), lambda x: F.struct(
        x.label.alias("label"), x.pos.alias("pos"),
        *[_model_decision(m, x[f"r{i}"]).alias(f"v{i}") for i, m in enumerate(models)]))
    per_model = F.array(*[F.struct(F.lit(m.name).alias("model"),
                                   _row_items(i, F.col("_verdicts"), F.col(labels_col)).alias("items"))
                          for i, m in enumerate(models)])
    return raws, verdicts, per_model


def batch_results_in_row(docs: DataFrame, models=RULE_MODELS, candidates_col: str = "candidates",
                         labels_col: str = "PIIs") -> DataFrame:
    """C-02/C-03 without any shuffle: one reasoning-mode ``BatchResult`` per (document, model)
    from the document's own candidate array (output of ``detect_arrays``). Other columns of
    ``docs`` are carried through.

    Every model's verdict is evaluated once per candidate into a staged column (lambdas get
    no common-subexpression elimination), then grouped per label with cheap array filters.
    """
    keep = [c for c in docs.columns if c not in (candidates_col, labels_col)]
    raws, verdicts, per_model = _batch_plan(tuple(models), candidates_col, labels_col)
    staged = docs.select(*keep, labels_col, raws.alias("_raws"))
    staged = staged.select(*keep, labels_col, verdicts.alias("_verdicts"))
    rows = staged.select(*keep, labels_col, F.inline(per_model))
    empty = F.size(labels_col) == 0
    return rows.select(
        *keep, "model", F.col(labels_col).alias("detected_piis"),
        F.when(empty, F.array().cast(f"array<{VERDICT_ITEM}>")).otherwise(F.col("items"))
         .cast(f"array<{VERDICT_ITEM}>").alias("verified_piis"),
        empty.alias("short_circuit"),
        F.when(empty, F.lit(0.0)).alias("latency_ms"))


def candidate_model_verdicts(cands: DataFrame, models=RULE_MODELS) -> DataFrame:
    """All models over the candidates in one pass (one projection + explode, no re-scan);
    each model's regex chains are evaluated once into a staged column."""
    base = ["doc_id", "entity_type", "label", "entity_value", "pos"]
    staged = cands.select(*base, *[_model_raw(m).alias(f"_r{i}") for i, m in enumerate(models)])
    arr = F.array(*[F.when(F.col(f"_r{i}").isNotNull(), F.struct(
        F.lit(m.name).alias("model"), _model_decision(m, F.col(f"_r{i}"))["verified"].alias("verified"),
        _model_decision(m, F.col(f"_r{i}"))["reason"].alias("reason"))) for i, m in enumerate(models)])
    return staged.select(*base, F.inline(F.filter(arr, lambda x: x.isNotNull())))


def label_verdicts(cand_verdicts: DataFrame) -> DataFrame:
    """Table form (candidates arriving as rows, e.g. from an upstream detector's entity
    table): label-level verdict per (record, model); any located value verified -> verified.

    The reason is that of the earliest value carrying the label's verdict.
    """
    return cand_verdicts.groupBy("doc_id", "model", "label").agg(
        F.bool_or("verified").alias("verified"),
        F.min_by("reason", F.struct(~F.col("verified"), F.col("pos"))).alias("reason"))


def batch_results(records: DataFrame, labels: DataFrame, models=RULE_MODELS) -> DataFrame:
    """C-02/C-03: one reasoning-mode ``BatchResult`` per (record, model).

    ``records``: (doc_id, PIIs, extra columns carried through); ``labels``: output of
    ``label_verdicts``. Records without
    detected labels short-circuit to ``verified_piis = []`` and latency 0.0 (not scored);
    a model that does not handle a label leaves it out of its reply.
    """
    per = labels.groupBy("doc_id", "model").agg(F.array_sort(F.collect_list(
        F.struct(F.col("label").alias("pii"), "verified", "reason"))).alias("_v"))
    names = F.array(*[F.lit(m.name) for m in models])
    extra = [c for c in records.columns if c not in ("doc_id", "PIIs")]
    rows = records.select("doc_id", "PIIs", *extra, F.explode(names).alias("model"))
    out = rows.join(per, ["doc_id", "model"], "left")
    empty = F.size("PIIs") == 0
    return out.select(
        "doc_id", "model", *extra, F.col("PIIs").alias("detected_piis"),
        F.when(empty, F.array().cast(f"array<{VERDICT_ITEM}>"))
         .otherwise(F.coalesce("_v", F.array().cast(f"array<{VERDICT_ITEM}>")))
         .alias("verified_piis"),
        empty.alias("short_circuit"),
        F.when(empty, F.lit(0.0)).alias("latency_ms"))


def batch_result_summary(batch: DataFrame) -> DataFrame:
    """E-13 + H-06 on batch results: any-verified flag, counts, confidence 1.0/0.0, rejected."""
    v = F.col("verified_piis")
    names_ok = F.transform(F.filter(v, lambda x: x.verified), lambda x: x.pii)
    n_ok = F.size(names_ok)
    return batch.select(
        "doc_id", "model", "short_circuit",
        F.size("detected_piis").alias("n_detected"),
        n_ok.alias("n_verified"),
        (n_ok > 0).alias("any_verified"),
        F.when(n_ok > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("confidence"),
        F.array_join(F.array_sort(names_ok), "|").alias("verified"),
        F.array_join(F.array_sort(F.array_except("detected_piis", names_ok)), "|").alias("rejected"))


def results_long(results: DataFrame, model_col: str = "model", order_col: str = "load_order",
                 id_col: str = "recordId", input_col: str = "input",
                 items_col: str = "verified_piis", text_chars: int = 200, fill_nulls: bool = True) -> DataFrame:
    """C-05/C-06/I-31: result rows -> long (record, pii, model, verified, reason, order).

    Only struct items count (string items of simple mode are ignored by construction: the
    column must be ``array<struct<pii,verified,reason>>``). A record without an id is 'unknown', a
    null input ''. A typed item cannot tell a missing key from a null, so nulls take the defaults:
    pii '', verified false, reason 'No reason provided'. ``sources.jsonl.read_results`` fills missing keys
    itself; with ``fill_nulls=False`` the nulls that it leaves, the explicit ones, stay (a null
    verdict counts as not verified). The input is truncated before any shuffle.
    """
    exploded = results.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("unknown")).alias("record_id"),
        truncate_text(F.coalesce(F.col(input_col), F.lit("")), text_chars).alias("input_text"),
        F.col(model_col).alias("model"), F.col(order_col).alias("load_order"),
        F.posexplode(generator_input(items_col)).alias("item_pos", "item"))
    return exploded.select(
        "record_id", "input_text", "model", "load_order", "item_pos",
        *([F.coalesce("item.pii", F.lit("")).alias("pii"), F.coalesce("item.verified", F.lit(False)).alias("verified"),
           F.coalesce("item.reason", F.lit(cat.CONSOLIDATE_NO_REASON)).alias("reason")] if fill_nulls
          else ["item.pii", F.coalesce("item.verified", F.lit(False)).alias("verified"), "item.reason"]))


def model_order(long: DataFrame) -> DataFrame:
    """E-17: models in order of first appearance."""
    return long.groupBy("model").agg(F.min("load_order").alias("first_seen")).orderBy("first_seen")


def consolidate(long: DataFrame, models: list[str]) -> DataFrame:
    """E-18 ... E-20 + C-13 + G-05: the wide comparison table.

    Per (record, pii, model) the last-seen verdict wins; per record the first-seen input
    wins; each model contributes ``{model}_Verified`` (YES / NO / N/A) and
    ``{model}_Reason``. ``models`` fixes the pivot values and their column order.
    """
    order = F.struct("load_order", "item_pos")
    # One partial/final aggregation per (record, pii): the pivot written as conditional
    # max_by per model, plus the cell's earliest input. A record id carrying a third of all
    # lines is reduced map-side here; the window afterwards sees at most #PIIs rows per
    # record, and the upstream (detection, verifiers) is evaluated once.
    per_model = [F.max_by(F.struct("verified", "reason"),
                          F.when(F.col("model") == m, order)).alias(m) for m in models]
    cells = (long.groupBy("record_id", "pii")
             .agg(*per_model, F.min(order).alias("_first"),
                  F.min_by("input_text", order).alias("_input"))
             .withColumn("input_text", F.min_by("_input", "_first").over(Window.partitionBy("record_id"))))
    cols = [F.col("record_id"), F.col("input_text"), F.col("pii")]
    for m in models:
        c = F.col(f"`{m}`")
        cols.append(F.when(c.isNull(), F.lit(cat.CONSOLIDATE_NA))
                    .when(c.verified, F.lit("YES")).otherwise(F.lit("NO")).alias(f"{m}_Verified"))
        cols.append(F.when(c.isNull(), F.lit(cat.CONSOLIDATE_NOT_PROCESSED))
                    .otherwise(c.reason).alias(f"{m}_Reason"))
    return cells.select(*cols).orderBy("record_id", "pii")


def consensus(long: DataFrame) -> DataFrame:
    """E-21: agreement across models per (record, pii) on each model's last verdict."""
    last = long.groupBy("record_id", "pii", "model").agg(
        F.max_by("verified", F.struct("load_order", "item_pos")).alias("verified"))
    agg = last.groupBy("record_id", "pii").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.count_if("verified").alias("n_verified"),
        F.bool_or("verified").alias("any_verified"),
        F.bool_and("verified").alias("all_verified"))
    # verified is never NULL here, so "one distinct value" = all false or all true — no
    # distinct aggregation (and its extra shuffle) needed
    return agg.select(
        "record_id", "pii", "n_models", "n_verified",
        ((F.col("n_verified") == 0) | (F.col("n_verified") == F.col("n_models"))).alias("all_agree"),
        "any_verified", "all_verified",
        (F.col("n_verified") / F.col("n_models")).alias("vote_share"))


def rejection_by_type(long: DataFrame) -> DataFrame:
    """E-22: rejection rate per PII type and model, with ROLLUP subtotals.

    ``level`` = 0 for (pii, model), 1 for the pii subtotal, 3 for the grand total.
    """
    last = long.groupBy("record_id", "pii", "model").agg(
        F.max_by("verified", F.struct("load_order", "item_pos")).alias("verified"))
    return last.rollup("pii", "model").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("verified")).alias("n_rejected"),
        (F.count_if(~F.col("verified")) / F.count(F.lit(1))).alias("rejection_rate"))


def record_pii_counts(long: DataFrame) -> DataFrame:
    """E-16: distinct PIIs per record and the number of models that reported it."""
    return long.groupBy("record_id").agg(
        F.count_distinct("pii").alias("n_piis"),
        F.count_distinct("model").alias("n_models"))


def first_record(df, predicate: Column | None = None, order_col: str = "recordId"):
    """G-07: first record (by id) satisfying ``predicate`` — a top-1, not a sort of all rows."""
    rows = df if predicate is None else df.filter(predicate)
    return rows.orderBy(order_col).limit(1)


def lookup_record(df, record_id: str, id_col: str = "recordId"):
    """C-12: point lookup by record id (pushed down to the scan when reading parquet)."""
    return df.filter(F.col(id_col) == F.lit(record_id))
