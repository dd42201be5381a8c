"""Registered queries: each reads the driver tables from ``sf_dir`` and composes operators.

``QUERIES[name] = (spark_fn, oracle_sql or None)``; ``spark_fn(spark, sf_dir)`` returns a
DataFrame whose columns are named exactly like the oracle SQL's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draw import draw as _draw
from ..functions.text import truncate_text
from .. import catalogue as _cat
from ..operators import consolidate, datagen, decisions, detect, prompts, quantiles, scorer, stats, training, verify
from ..operators import replies as replies_op
from ..operators.rows import keep_if
from ..session import checkpoint_dir, deal, spread, table
from ..sources import jsonl
from . import oracle as O

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# --------------------------------------------------------------------------- detection
def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_candidates(_documents(spark, sf_dir))


def candidate_verdicts(spark: SparkSession, sf_dir: str, window: int = verify.DEFAULT_WINDOW):
    return verify.verify_candidates(candidates(spark, sf_dir), window=window)


_CAND_COLS = "doc_id, entity_type, label, entity_value, pos, context, ctx_offset"


@register("detect_candidates", f"SELECT {_CAND_COLS} FROM {O.detect_sql()} d")
def q_detect_candidates(spark, sf_dir):
    """J-01: PII candidates in documents."""
    return candidates(spark, sf_dir)


_VERDICT_COLS = ("doc_id", "entity_type", "label", "entity_value", "pos", "guard_reason",
                 "own", "spec", "ctx", "verified", "confidence", "reason")


@register("verify_candidates",
          f"SELECT {', '.join(_VERDICT_COLS)} FROM {O.verify_sql(O.detect_sql())} v")
def q_verify_candidates(spark, sf_dir):
    """J-03/J-04: three-test rule verdict per candidate."""
    return candidate_verdicts(spark, sf_dir).select(*_VERDICT_COLS)


@register("value_verdicts", f"""
SELECT doc_id, entity_type, label, entity_value, CAST(count(*) AS BIGINT) AS n_occurrences,
  CAST(count_if(verified) AS BIGINT) AS n_verified, bool_or(verified) AS verified,
  arg_min(pos, (NOT verified, pos)) AS first_pos, arg_min(reason, (NOT verified, pos)) AS reason
FROM {O.verify_sql(O.detect_sql())} v GROUP BY doc_id, entity_type, label, entity_value""")
def q_value_verdicts(spark, sf_dir):
    """J-03/J-04 per value: verified if any of its occurrences is."""
    return verify.value_verdicts(candidate_verdicts(spark, sf_dir))


@register("verification_summary", f"""
SELECT entity_type, CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(verified) AS BIGINT) AS verified,
       CAST(count_if(NOT verified) AS BIGINT) AS rejected,
       coalesce(CAST(count_if(verified) AS DOUBLE) / nullif(count(*), 0), 0.0) AS verification_rate
FROM {O.verify_sql(O.detect_sql())} v GROUP BY entity_type""")
def q_verification_summary(spark, sf_dir):
    """Flagship: documents -> J-01 -> J-03/J-04 -> E-01/E-02 per entity type (G-05 order)."""
    return verify.verification_summary(candidate_verdicts(spark, sf_dir))


# --------------------------------------------------------------------------- statistics
def inference_log(spark, sf_dir):
    return stats.inference_log_from_events(table(spark, sf_dir, "events"))


_LOG_SQL = """(SELECT event_type AS model, event_id AS record_id, round(value, 2) AS latency_ms,
  round(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0, 4) AS confidence,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 >= 0.5 AS verified, ts
  FROM events)"""

_SPAN = "date_diff('microsecond', min(ts), max(ts))"
_STATS_SQL = f"""
SELECT model, CAST(count(*) AS BIGINT) AS total, CAST(count_if(verified) AS BIGINT) AS verified,
  CAST(count_if(NOT verified) AS BIGINT) AS rejected,
  coalesce(CAST(count_if(verified) AS DOUBLE) / nullif(count(*), 0), 0.0) AS verification_rate,
  round(sum(latency_ms), 4) / count(latency_ms) AS latency_mean,
  round(quantile_cont(latency_ms, 0.5), 6) AS latency_median, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50,
  round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99,
  min(latency_ms) AS latency_min, max(latency_ms) AS latency_max,
  round(sum(confidence), 6) / count(confidence) AS confidence_mean, round(quantile_cont(confidence, 0.5), 8) AS confidence_median,
  min(confidence) AS confidence_min, max(confidence) AS confidence_max,
  coalesce({_SPAN} / 1e6, 0.0) AS total_time_sec,
  CASE WHEN {_SPAN} > 0 THEN count(*) / ({_SPAN} / 1e6) ELSE 0.0 END AS items_per_sec
FROM {_LOG_SQL} l GROUP BY model"""


@register("model_stats", _STATS_SQL)
def q_model_stats(spark, sf_dir):
    """E-01 ... E-10: per-model verification, latency, confidence and throughput stats."""
    return stats.model_stats(inference_log(spark, sf_dir))


@register("best_performers", f"""
SELECT arg_min(model, (latency_p95, model)) AS fastest_model, min(latency_p95) AS fastest_p95,
  arg_min(model, (-confidence_mean, model)) AS most_confident_model,
  max(confidence_mean) AS highest_confidence_mean,
  arg_min(model, (verification_rate, model)) AS most_selective_model,
  min(verification_rate) AS lowest_verification_rate
FROM ({_STATS_SQL}) s""")
def q_best_performers(spark, sf_dir):
    """G-01 ... G-04: fastest (p95), most confident, most selective model."""
    return stats.best_performers(stats.model_stats(inference_log(spark, sf_dir)))


@register("overall_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(verified) AS BIGINT) AS verified,
  CAST(count_if(NOT verified) AS BIGINT) AS rejected,
  coalesce(CAST(count_if(verified) AS DOUBLE) / nullif(count(*), 0), 0.0) AS verification_rate,
  round(sum(latency_ms), 4) / count(latency_ms) AS latency_mean,
  round(quantile_cont(latency_ms, 0.5), 6) AS latency_median, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50,
  round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99,
  min(latency_ms) AS latency_min, max(latency_ms) AS latency_max,
  round(sum(confidence), 6) / count(confidence) AS confidence_mean, round(quantile_cont(confidence, 0.5), 8) AS confidence_median,
  min(confidence) AS confidence_min, max(confidence) AS confidence_max,
  coalesce({_SPAN} / 1e6, 0.0) AS total_time_sec,
  CASE WHEN {_SPAN} > 0 THEN count(*) / ({_SPAN} / 1e6) ELSE 0.0 END AS items_per_sec
FROM {_LOG_SQL} l""")
def q_overall_stats(spark, sf_dir):
    """E-11: one-row run summary over all models."""
    return stats.overall_stats(inference_log(spark, sf_dir))


@register("batch_sequence", f"""
SELECT model, record_id, CAST(row_number() OVER (PARTITION BY model ORDER BY ts, record_id) AS BIGINT) AS seq,
  CAST(floor((row_number() OVER (PARTITION BY model ORDER BY ts, record_id) - 1) / 32) AS BIGINT) AS batch_id
FROM {_LOG_SQL} l""")
def q_batch_sequence(spark, sf_dir):
    """F-01: per-model sequence number and fixed-size batch (32) without a hot task."""
    log = inference_log(spark, sf_dir)
    return stats.assign_batches(log, 32, ["model"], ["ts", "record_id"]).select(
        "model", "record_id", F.col("seq").cast("bigint").alias("seq"), "batch_id")


@register("batch_latency", f"""
SELECT model, batch_id, CAST(count(*) AS BIGINT) AS batch_size, round(sum(latency_ms), 4) AS batch_ms,
  round(sum(latency_ms), 4) / count(*) AS per_item_ms
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY model ORDER BY ts, record_id) - 1) / 32) AS BIGINT) AS batch_id
      FROM {_LOG_SQL} l) b GROUP BY model, batch_id""")
def q_batch_latency(spark, sf_dir):
    """F-04: per-item latency = batch time / batch size."""
    log = inference_log(spark, sf_dir)
    return stats.batch_latency(stats.assign_batches(log, 32, ["model"], ["ts", "record_id"]),
                               ["model"])


@register("windowed_stats", f"""
SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, model,
  CAST(count(*) AS BIGINT) AS total, CAST(count_if(verified) AS BIGINT) AS verified,
  CAST(count_if(verified) AS DOUBLE) / count(*) AS verification_rate,
  round(sum(latency_ms), 4) / count(latency_ms) AS latency_mean, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95,
  max(latency_ms) AS latency_max
FROM {_LOG_SQL} l GROUP BY 1, model""")
def q_windowed_stats(spark, sf_dir):
    """L-02 batch twin: hourly tumbling-window stats per model."""
    return stats.windowed_stats(inference_log(spark, sf_dir))


# --------------------------------------------------------------------------- result files
def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/piisieve/{name}-{uuid.uuid4().hex}"


def _write_result_files(df: DataFrame, path: str, order: list[str]) -> None:
    """One folder ``<file>`` per result file, whose part files hold its lines in ``order``."""
    keys = ["file", *order]
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*order).write.partitionBy("file")
     .option("ignoreNullFields", False).json(path))


@register("result_file_stats", _STATS_SQL.replace("SELECT model, CAST(count", """SELECT model, 'event' AS model_type,
  CAST(max(part) AS VARCHAR) AS model_params, 'file=' || max(part) || '_' || model AS file_name, CAST(count""").replace(
    "FROM " + _LOG_SQL, """FROM (SELECT *, record_id % 3 AS part, max(record_id % 3) OVER (PARTITION BY model) AS last
  FROM """ + _LOG_SQL + " x)").replace(" l GROUP BY model", " l WHERE part = last GROUP BY model"))
def q_result_file_stats(spark, sf_dir):
    """A-06, A-08, E-09, E-10: result files written, read back and summed up; a model's last file counts."""
    log = stats.inference_log_from_events(deal(table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", "props", "ts")))
    part = (F.col("record_id") % 3).cast("string")
    rows = log.select(
        F.concat(part, F.lit("_"), "model", F.lit(".jsonl")).alias("file"), F.col("record_id").alias("_order"),
        F.col("record_id").cast("string").alias("recordId"), F.lit("").alias("input"), F.lit("E").alias("entityType"),
        F.lit("v").alias("entityValue"),
        F.struct("verified", "confidence", F.lit("r").alias("reason"), F.col("latency_ms").alias("latencyMs")).alias("result"),
        F.struct(F.col("model").alias("name"), F.lit("event").alias("type"), part.alias("parameters")).alias("model"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))
    path = _scratch(spark, "results")
    _write_result_files(rows, path, ["_order"])
    return stats.file_stats(jsonl.read_entity_results(spark, path))


@register("result_file_consolidation", f"""
WITH r AS (SELECT 'r' || (event_id % 500) AS record_id, 'p' || (event_id % 7) AS pii, event_id % 3 AS f, event_id,
                  CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AS verified FROM events),
i AS (SELECT record_id, arg_min('text ' || event_id, (f, event_id)) AS input_text FROM r GROUP BY record_id),
c AS (SELECT record_id, pii, f, arg_max(verified, event_id) AS verified, arg_max('reason ' || event_id, event_id) AS reason
      FROM r GROUP BY record_id, pii, f)
SELECT record_id, input_text, pii,
  {", ".join(f"""coalesce(max(CASE WHEN f = {k} THEN CASE WHEN verified THEN 'YES' ELSE 'NO' END END), 'N/A') AS "file={k}_Verified",
  coalesce(max(CASE WHEN f = {k} THEN reason END), 'Not processed by this model') AS "file={k}_Reason" """ for k in range(3))}
FROM c JOIN i USING (record_id) GROUP BY record_id, input_text, pii""")
def q_result_file_consolidation(spark, sf_dir):
    """E-17 ... E-20, F-02 over files with real duplicates: first input of a record, last verdict of a cell."""
    e = deal(table(spark, sf_dir, "events").select("event_id", "props"))
    text = F.col("event_id").cast("string")
    item = F.struct(F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("pii"),
                    (F.get_json_object("props", "$.k").cast("double") >= 50).alias("verified"),
                    F.concat(F.lit("reason "), text).alias("reason"))
    rows = e.select(F.concat((F.col("event_id") % 3).cast("string"), F.lit(".jsonl")).alias("file"), F.col("event_id").alias("_order"),
                    F.concat(F.lit("r"), (F.col("event_id") % 500).cast("string")).alias("recordId"),
                    F.concat(F.lit("text "), text).alias("input"), F.array(item).alias("verified_piis"))
    path = _scratch(spark, "runs")
    _write_result_files(rows, path, ["_order"])
    files = [f"{path}/file={k}.jsonl" for k in range(3)]
    long = consolidate.results_long(jsonl.read_results(spark, files), model_col="model_tag")
    return consolidate.consolidate(long, [f"file={k}" for k in range(3)])


# --------------------------------------------------------------------------- consolidation
def rule_batch_results(spark, sf_dir, models=consolidate.RULE_MODELS):
    """Reasoning-mode batch results of the rule-verifier variants over all documents.

    Map-only: detection, per-model label verdicts and result rows are computed inside each
    document's row; the first shuffle is the cross-document consolidation that follows.
    """
    docs = detect.detect_arrays(_documents(spark, sf_dir)).select(
        "doc_id", truncate_text("text", 200).alias("input_text"), "candidates", "PIIs")
    batch = consolidate.batch_results_in_row(docs, models)
    order = {m.name: i for i, m in enumerate(models)}
    load_order = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return batch.withColumn("load_order", F.element_at(load_order, F.col("model")).cast("bigint"))


def rule_long(spark, sf_dir, models=consolidate.RULE_MODELS):
    batch = rule_batch_results(spark, sf_dir, models)
    return consolidate.results_long(batch, id_col="doc_id", input_col="input_text")


_MODELS = consolidate.RULE_MODELS
_LONG = O.long_sql(_MODELS)


def _pivot_sql(models) -> str:
    cells = []
    for m in models:
        n = m.name
        cells.append(f"coalesce(max(CASE WHEN model = {O.q(n)} THEN CASE WHEN verified THEN 'YES' ELSE 'NO' END END), 'N/A') AS \"{n}_Verified\"")
        cells.append(f"coalesce(max(CASE WHEN model = {O.q(n)} THEN reason END), 'Not processed by this model') AS \"{n}_Reason\"")
    return f"""SELECT record_id, arg_min(input_text, load_order) AS input_text, pii, {', '.join(cells)}
FROM {_LONG} l GROUP BY record_id, pii"""


@register("consolidated_comparison", _pivot_sql(_MODELS))
def q_consolidated(spark, sf_dir):
    """E-18 ... E-20, C-13, I-13, D-08, G-05: wide YES/NO/N/A comparison of verifiers."""
    return consolidate.consolidate(rule_long(spark, sf_dir), [m.name for m in _MODELS])


@register("verifier_consensus", f"""
SELECT record_id, pii, CAST(count(*) AS BIGINT) AS n_models, CAST(count_if(verified) AS BIGINT) AS n_verified,
  count(DISTINCT verified) = 1 AS all_agree, bool_or(verified) AS any_verified,
  bool_and(verified) AS all_verified, count_if(verified) / count(*) AS vote_share
FROM {_LONG} l GROUP BY record_id, pii""")
def q_consensus(spark, sf_dir):
    """E-21: agreement of the verifiers per (record, pii)."""
    return consolidate.consensus(rule_long(spark, sf_dir))


@register("rejection_by_type", f"""
SELECT pii, model, CAST(grouping(pii, model) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n,
  CAST(count_if(NOT verified) AS BIGINT) AS n_rejected, count_if(NOT verified) / count(*) AS rejection_rate
FROM {_LONG} l GROUP BY ROLLUP (pii, model)""")
def q_rejection_by_type(spark, sf_dir):
    """E-22: rejection rate per PII type and verifier with rollup subtotals."""
    return consolidate.rejection_by_type(rule_long(spark, sf_dir))


@register("record_pii_counts", f"""
SELECT record_id, CAST(count(DISTINCT pii) AS BIGINT) AS n_piis, CAST(count(DISTINCT model) AS BIGINT) AS n_models
FROM {_LONG} l GROUP BY record_id""")
def q_record_pii_counts(spark, sf_dir):
    """E-16: distinct PIIs per record (and reporting models)."""
    return consolidate.record_pii_counts(rule_long(spark, sf_dir))


def _batch_summary_sql(models) -> str:
    names = ", ".join(O.q(m.name) for m in models)
    return f"""
WITH det AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS piis FROM {O.detect_sql()} c GROUP BY doc_id),
rec AS (SELECT d.doc_id, coalesce(det.piis, []::VARCHAR[]) AS piis FROM documents d LEFT JOIN det ON d.doc_id = det.doc_id),
rm AS (SELECT doc_id, piis, unnest([{names}]) AS model FROM rec),
lv AS {O.model_label_verdicts_sql(models)},
per AS (SELECT doc_id, model, list_sort(list(label) FILTER (WHERE verified)) AS ok,
               count(*) AS n_items FROM lv GROUP BY doc_id, model)
SELECT rm.doc_id, rm.model, len(rm.piis) = 0 AS short_circuit, CAST(len(rm.piis) AS INTEGER) AS n_detected,
  CAST(CASE WHEN len(rm.piis) = 0 THEN 0 ELSE coalesce(len(per.ok), 0) END AS INTEGER) AS n_verified,
  CASE WHEN len(rm.piis) = 0 THEN FALSE ELSE coalesce(len(per.ok), 0) > 0 END AS any_verified,
  CASE WHEN len(rm.piis) > 0 AND coalesce(len(per.ok), 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN len(rm.piis) = 0 THEN '' ELSE array_to_string(coalesce(per.ok, []::VARCHAR[]), '|') END AS verified,
  array_to_string(list_sort(list_filter(rm.piis, lambda x: NOT list_contains(CASE WHEN len(rm.piis) = 0 THEN []::VARCHAR[] ELSE coalesce(per.ok, []::VARCHAR[]) END, x))), '|') AS rejected
FROM rm LEFT JOIN per ON rm.doc_id = per.doc_id AND rm.model = per.model"""


@register("batch_result_summary", _batch_summary_sql(_MODELS))
def q_batch_result_summary(spark, sf_dir):
    """C-02/C-03/E-13/H-06: per (record, model) batch result with short circuit and counts."""
    return consolidate.batch_result_summary(rule_batch_results(spark, sf_dir))


# --------------------------------------------------------------------------- prompts & replies
def detected_docs(spark, sf_dir):
    """Documents with at least one detected label: (doc_id, text, PIIs sorted distinct),
    labels computed in the row (no join back to the documents)."""
    arr = detect.detect_arrays(_documents(spark, sf_dir)).select("doc_id", "text", "PIIs")
    return keep_if(arr, lambda r: F.size(r.PIIs) > 0)


_DET = O.detected_records_sql()


@register("batch_prompts", f"""
SELECT doc_id, mode, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_chars, CAST(len(piis) AS INTEGER) AS n_labels
FROM (SELECT doc_id, mode, piis, {O.batch_prompt_sql('text', 'piis', 'mode')} AS p
      FROM (SELECT *, unnest(['simple', 'reasoning']) AS mode FROM {_DET} r) r2) t""")
def q_batch_prompts(spark, sf_dir):
    """D-03, J-06, I-15, I-16: batch verification prompt per (document, mode)."""
    pt = prompts.prompt_table(detected_docs(spark, sf_dir), id_col="doc_id", text_col="text")
    return pt.select("doc_id", "mode", F.md5("prompt").alias("prompt_md5"),
                     F.length("prompt").alias("prompt_chars"), F.size("PIIs").alias("n_labels"))


@register("single_prompts", f"""
SELECT c.doc_id, c.entity_type, c.entity_value, md5({O.single_prompt_sql('d.text', 'c.entity_type', 'c.entity_value')}) AS prompt_md5,
  CAST(length({O.single_prompt_sql('d.text', 'c.entity_type', 'c.entity_value')}) AS INTEGER) AS prompt_chars
FROM (SELECT DISTINCT doc_id, entity_type, entity_value FROM {O.detect_sql()} c0) c JOIN documents d ON c.doc_id = d.doc_id""")
def q_single_prompts(spark, sf_dir):
    """J-05: single-entity prompt per distinct candidate value (context = the whole document)."""
    docs = _documents(spark, sf_dir)
    text = F.col("text")

    def one(c):
        p = prompts.single_prompt(text, c.entity_type, c.entity_value)
        return F.struct(c.entity_type.alias("entity_type"), c.entity_value.alias("entity_value"),
                        F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_chars"))
    # the prompt needs the whole text: build it in the document's row, never join text back
    arr = detect.detect_arrays(docs)
    values = F.array_distinct(F.transform("candidates", lambda c: F.struct(
        c.entity_type.alias("entity_type"), c.entity_value.alias("entity_value"))))
    return arr.select("doc_id", "text", values.alias("found")).select(
        "doc_id", F.inline(F.transform("found", one)))


@register("parse_simple_replies", f"""
SELECT doc_id, parse_path, array_to_string(verified, '|') AS verified, CAST(len(verified) AS INTEGER) AS n_verified
FROM {O.parse_simple_sql(f"(SELECT doc_id, piis, {O.simple_reply_sql('doc_id', 'piis')} AS raw_response FROM {_DET} r)")} p""")
def q_parse_simple(spark, sf_dir):
    """P-10 ... P-15 on simple-mode replies of the seeded stand-in model."""
    replies = scorer.simulated_replies(detected_docs(spark, sf_dir), "simple")
    p = replies_op.staged(replies, replies_op.parse_simple, "raw_response", "PIIs")
    return p.select("doc_id", "p.parse_path", F.array_join("p.verified", "|").alias("verified"),
                    F.size("p.verified").alias("n_verified"))


@register("parse_reasoning_replies", f"""
SELECT doc_id, parse_path, CAST(unnest(range(len(items))) AS INTEGER) AS item_pos, unnest(items, recursive := true)
FROM {O.parse_reasoning_sql(f"(SELECT doc_id, piis, {O.reasoning_reply_sql('doc_id', 'piis')} AS raw_response FROM {_DET} r)")} p""")
def q_parse_reasoning(spark, sf_dir):
    """P-04 ... P-09 on reasoning-mode replies of the seeded stand-in model (long form)."""
    replies = scorer.simulated_replies(detected_docs(spark, sf_dir), "reasoning")
    p = replies_op.staged(replies, replies_op.parse_reasoning, "raw_response", "PIIs")
    return p.select("doc_id", "p.parse_path", F.posexplode("p.items").alias("item_pos", "item")).select(
        "doc_id", "parse_path", "item_pos", "item.pii", "item.verified", "item.reason")


@register("parse_single_replies", f"""
SELECT doc_id, entity_value, {O.parse_single_sql('raw_response')}
FROM (SELECT doc_id, entity_value, {O.single_reply_sql('doc_id', 'entity_value')} AS raw_response FROM {O.detect_sql()} c) r""")
def q_parse_single(spark, sf_dir):
    """P-01 ... P-03 on single-entity replies of the seeded stand-in model."""
    cands = candidates(spark, sf_dir).select("doc_id", "entity_value")
    r = cands.withColumn("raw_response", scorer.single_reply("doc_id", F.col("entity_value")))
    return replies_op.staged(r, replies_op.parse_single, "raw_response").select(
        "doc_id", "entity_value", "p.verified", "p.confidence", "p.reason", "p.parse_path")


# --------------------------------------------------------------------------- generated data & accuracy
def _seeds(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


_GEN_ALL = f"({datagen.generate_sql('(SELECT doc_id AS id FROM documents)', 'all')})"


@register("generated_entity_tests", f"SELECT * FROM {_GEN_ALL} g")
def q_generated_entity_tests(spark, sf_dir):
    """K-01 ... K-05, H-01: seeded labelled entity records, one per document and generator."""
    return datagen.generate(_seeds(spark, sf_dir), "all").drop("metadata")


@register("entity_verification_metrics", f"""
SELECT entityType, CAST(count_if(verified AND is_true_positive) AS BIGINT) AS tp,
  CAST(count_if(verified AND NOT is_true_positive) AS BIGINT) AS fp,
  CAST(count_if(NOT verified AND is_true_positive) AS BIGINT) AS fn,
  CAST(count_if(NOT verified AND NOT is_true_positive) AS BIGINT) AS tn,
  count_if(verified AND is_true_positive) / nullif(count_if(verified AND is_true_positive) + count_if(verified AND NOT is_true_positive), 0) AS precision,
  count_if(verified AND is_true_positive) / nullif(count_if(verified AND is_true_positive) + count_if(NOT verified AND is_true_positive), 0) AS recall,
  2 * count_if(verified AND is_true_positive) / nullif(2 * count_if(verified AND is_true_positive) + count_if(verified AND NOT is_true_positive) + count_if(NOT verified AND is_true_positive), 0) AS f1,
  count_if(verified AND NOT is_true_positive) / nullif(count_if(verified AND NOT is_true_positive) + count_if(NOT verified AND NOT is_true_positive), 0) AS fpr
FROM {O.entity_verdicts_sql(_GEN_ALL)} v GROUP BY ROLLUP (entityType)""")
def q_entity_verification_metrics(spark, sf_dir):
    """E-12 / D-09: rule-verifier precision, recall, F1 and FPR against generated truth."""
    tests = datagen.generate(_seeds(spark, sf_dir), "all")
    verdicts = verify.verify_entities(tests)
    return verify.confusion_metrics(verdicts)


# --------------------------------------------------------------------------- scorer-output decisions
_TYPES_SQL = "[" + ", ".join(O.q(t) for t in _cat.ENTITY_TYPES) + "]"


@register("logit_decisions", f"""
SELECT vec_id, entity_type, {O.logit_decision_sql('logits', 'entity_type')}
FROM (SELECT vec_id, coalesce(({_TYPES_SQL})[label + 1], 'UNKNOWN') AS entity_type,
             CAST(embedding[1:2] AS DOUBLE[]) AS logits FROM embeddings) e""")
def q_logit_decisions(spark, sf_dir):
    """J-09 (I-22, I-27, I-28): softmax decision over two logits taken from ``embeddings``."""
    emb = table(spark, sf_dir, "embeddings")
    types = F.array(*[F.lit(t) for t in _cat.ENTITY_TYPES])
    df = emb.select("vec_id",
                    F.coalesce(F.try_element_at(types, (F.col("label") + 1).cast("int")),
                               F.lit("UNKNOWN")).alias("entity_type"),
                    F.slice("embedding", 1, 2).cast("array<double>").alias("logits"))
    d = decisions.logit_decision(F.col("logits"), F.col("entity_type"))
    return df.select("vec_id", "entity_type", d.alias("d")).select(
        "vec_id", "entity_type", "d.verified", "d.confidence", "d.reason")


@register("span_decisions", f"""
SELECT doc_id, entity_type, entity_value, {O.type_alias_sql('entity_type')} AS scorer_label,
  {O.span_decision_sql('spans', 'entity_value')}
FROM (SELECT *, {O.spans_sql('doc_id', 'entity_value', 'context', 'ctx_offset')} AS spans FROM {O.detect_sql()} c) s""")
def q_span_decisions(spans_spark, sf_dir):
    """J-10 (D-04, I-20): two-threshold span verification on stand-in span-scorer output."""
    c = candidates(spans_spark, sf_dir)
    spans = scorer.simulated_spans("doc_id", F.col("entity_value"), F.col("context"), F.col("ctx_offset"))
    d = decisions.span_decision(spans, F.col("entity_value"))
    return c.select("doc_id", "entity_type", "entity_value",
                    decisions.scorer_label(F.col("entity_type")).alias("scorer_label"), d.alias("d")).select(
        "doc_id", "entity_type", "entity_value", "scorer_label", "d.verified", "d.confidence", "d.reason")


@register("token_decisions", f"""
SELECT doc_id, entity_type, entity_value, {O.token_decision_sql('tokens', 'context', 'entity_value')}
FROM (SELECT *, {O.tokens_sql('doc_id', 'entity_value', 'ctx_offset')} AS tokens FROM {O.detect_sql()} c) s""")
def q_token_decisions(spark, sf_dir):
    """J-11 (D-05, D-06, E-14, E-15): token-overlap verification on stand-in token labels."""
    c = candidates(spark, sf_dir)
    toks = scorer.simulated_tokens("doc_id", F.col("entity_value"), F.col("ctx_offset"))
    d = decisions.token_decision(toks, F.col("context"), F.col("entity_value"))
    return c.select("doc_id", "entity_type", "entity_value", d.alias("d")).select(
        "doc_id", "entity_type", "entity_value", "d.verified", "d.confidence", "d.reason")


# --------------------------------------------------------------------------- training set & JSON labels
_TRAIN_SQL = f"({training.generate_training_sql('documents', 'doc_id')})"


def training_category_map_sql() -> str:
    return "MAP {" + ", ".join(f"{O.q(n)}: {O.q(c)}" for n, c, _ in _cat.LABEL_CATALOGUE) + "}"


@register("training_set", f"""
SELECT recordId, element, slot, domain, template, input, array_to_string(PIIs, '|') AS piis,
  CAST(len(PIIs) AS INTEGER) AS n_piis, drawn_fp, is_true_positive FROM {_TRAIN_SQL} t""")
def q_training_set(spark, sf_dir):
    """K-06 ... K-13, J-12, J-14 ... J-16: four labelled examples per seed document id."""
    t = training.generate_training(_seeds(spark, sf_dir))
    return t.select("recordId", "element", "slot", "domain", "template", "input",
                    F.array_join("PIIs", "|").alias("piis"), F.size("PIIs").alias("n_piis"),
                    "drawn_fp", "is_true_positive")


@register("training_distribution", f"""
WITH t AS MATERIALIZED {_TRAIN_SQL}
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(len(PIIs) > 0) AS BIGINT) AS true_positive_records,
  CAST(count_if(len(PIIs) = 0) AS BIGINT) AS false_positive_records,
  CAST(count_if(starts_with(regexp_replace(input, '^[ \\t\\n\\r]+', ''), '{{')) AS BIGINT) AS json_records,
  CAST(count_if(NOT starts_with(regexp_replace(input, '^[ \\t\\n\\r]+', ''), '{{')) AS BIGINT) AS text_records,
  CAST(count_if(starts_with(regexp_replace(input, '^[ \\t\\n\\r]+', ''), '{{') AND len(PIIs) > 3) AS BIGINT) AS multi_pii_json_records,
  CAST(count_if(drawn_fp) AS BIGINT) AS drawn_false_positives, CAST(count(DISTINCT element) AS BIGINT) AS elements,
  CAST((SELECT count(DISTINCT l) FROM (SELECT unnest(PIIs) AS l FROM t) u) AS INTEGER) AS labels_covered,
  CAST(count_if(contains(({training_category_map_sql()})[element], 'Financial')) AS BIGINT) AS financial_records,
  CAST(count_if(contains(({training_category_map_sql()})[element], 'Health')) AS BIGINT) AS health_records
FROM t""")
def q_training_distribution(spark, sf_dir):
    """E-23/E-24, C-07 ... C-11: distribution of the generated labelled set."""
    return training.distribution(training.generate_training(_seeds(spark, sf_dir)))


def _customer_docs(spark, sf_dir):
    """Customer rows as JSON documents in three template shapes (nulls kept as keys)."""
    cust = deal(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    nation = table(spark, sf_dir, "nation")  # 25-row dimension: fixed size, safe to broadcast
    c = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
    email = F.when(F.col("c_acctbal") > 0, F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@shop.test")))
    opts = {"ignoreNullFields": "false"}
    profile = F.to_json(F.struct(F.col("c_custkey").alias("userId"), F.col("c_name").alias("firstName"),
                                 email.alias("email"),
                                 F.struct(F.col("n_name").alias("city")).alias("address")), opts)
    order = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), email.alias("email")).alias("customer"),
                               F.struct(F.col("n_name").alias("address")).alias("shipping")), opts)
    contact = F.to_json(F.struct(F.struct(
        F.struct(F.col("c_name").alias("value")).alias("firstname"),
        F.struct(F.lit(None).cast("string").alias("value")).alias("company")).alias("properties")), opts)
    seg = F.col("c_mktsegment")
    template = (F.when(seg == "BUILDING", F.lit("user_profile")).when(seg == "AUTOMOBILE", F.lit("ecommerce_order"))
                .otherwise(F.lit("hubspot_contact")))
    doc = F.when(seg == "BUILDING", profile).when(seg == "AUTOMOBILE", order).otherwise(contact)
    return c.select("c_custkey", template.alias("template"), doc.alias("doc"))


_CUSTOMER_DOCS_SQL = """(SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'user_profile' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'ecommerce_order'
       ELSE 'hubspot_contact' END AS template,
  CASE WHEN c_mktsegment = 'BUILDING' THEN json_object('userId', c_custkey, 'firstName', c_name,
         'email', CASE WHEN c_acctbal > 0 THEN lower(replace(c_name, '#', '.')) || '@shop.test' END,
         'address', json_object('city', n_name))::VARCHAR
       WHEN c_mktsegment = 'AUTOMOBILE' THEN json_object('customer', json_object('name', c_name,
         'email', CASE WHEN c_acctbal > 0 THEN lower(replace(c_name, '#', '.')) || '@shop.test' END),
         'shipping', json_object('address', n_name))::VARCHAR
       ELSE json_object('properties', json_object('firstname', json_object('value', c_name),
         'company', json_object('value', NULL)))::VARCHAR END AS doc
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


@register("customer_json_labels", f"""
SELECT c_custkey, template, array_to_string(l, '|') AS labels, CAST(len(l) AS INTEGER) AS n_labels
FROM (SELECT c_custkey, template, {training.path_labels(datagen.SqlGen('c_custkey'), 'doc', 'template')} AS l
      FROM {_CUSTOMER_DOCS_SQL} d) x""")
def q_customer_json_labels(spark, sf_dir):
    """J-12: key-path labelling of JSON documents built from customer rows."""
    d = training.json_path_labels(_customer_docs(spark, sf_dir), "doc", "template")
    return d.select("c_custkey", "template", F.array_join("labels", "|").alias("labels"),
                    F.size("labels").alias("n_labels"))


_DEEP_FIELDS = {p: lab for _, p, lab in training.PATH_LABELS}


def _deep_docs(d):
    """Every second document lies in objects and lists of another one, next to values that are not entered."""
    nested = F.concat(F.lit('{"id":'), F.col("c_custkey").cast("string"), F.lit(',"document":'), F.col("doc"), F.lit(',"history":['), F.col("doc"),
                      F.lit(',5,null,"email",['), F.col("doc"), F.lit(']],"email":{"list":[{"deep":['), F.col("doc"), F.lit(']}]}}'))
    return d.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, nested).otherwise(F.col("doc")).alias("doc"))


_DEEP_DOCS_SQL = f"""(SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN
  '{{"id":' || c_custkey || ',"document":' || doc || ',"history":[' || doc || ',5,null,"email",[' || doc ||
  ']],"email":{{"list":[{{"deep":[' || doc || ']}}]}}}}' ELSE doc END AS doc FROM {_CUSTOMER_DOCS_SQL} c)"""
_DEEP_MAP = "MAP {" + ", ".join(f"{O.q(k)}: {O.q(v)}" for k, v in _DEEP_FIELDS.items()) + "}"


@register("customer_json_deep_labels", f"""
WITH d AS (SELECT c_custkey, doc FROM {_DEEP_DOCS_SQL} x),
e AS (SELECT c_custkey, t.id AS n, replace(regexp_replace(t.fullkey, '\\[[0-9]+\\]', '', 'g'), '$.', '') AS f, CAST(t.key AS VARCHAR) AS k
      FROM d, json_tree(CAST(d.doc AS JSON)) t
      WHERE t.key IS NOT NULL AND NOT regexp_matches(t.fullkey, '\\]$') AND NOT contains(t.fullkey, '][')),
l AS (SELECT c_custkey, n, coalesce(({_DEEP_MAP})[f], ({_DEEP_MAP})[k]) AS label FROM e)
SELECT c_custkey, coalesce(string_agg(label, '|' ORDER BY n), '') AS labels FROM d LEFT JOIN l USING (c_custkey) GROUP BY c_custkey""")
def q_customer_json_deep_labels(spark, sf_dir):
    """J-13: walk that enters lists of objects, with bare-key fallback, over nested documents."""
    d = training.deep_json_labels(_deep_docs(_customer_docs(spark, sf_dir)), "doc", _DEEP_FIELDS)
    return d.select("c_custkey", F.array_join("labels", "|").alias("labels"))


# --------------------------------------------------------------------------- parser fidelity (E-26)
@register("reply_label_agreement", f"""
WITH r AS (SELECT doc_id, piis, {O.simple_reply_sql('doc_id', 'piis')} AS raw_response,
                  list_filter(piis, lambda d: {O.draw_sql('keep', 10, 'doc_id', 'd')} < 7) AS intended FROM {_DET} x),
p AS (SELECT p.doc_id, p.parse_path, p.verified, r.intended FROM {O.parse_simple_sql('r')} p JOIN r ON p.doc_id = r.doc_id),
a AS (SELECT parse_path, len(list_intersect(list_distinct(intended), list_distinct(verified))) AS tp,
             len(list_filter(list_distinct(verified), lambda x: NOT list_contains(intended, x))) AS fp,
             len(list_filter(list_distinct(intended), lambda x: NOT list_contains(verified, x))) AS fn FROM p)
SELECT parse_path, CAST(count(*) AS BIGINT) AS records, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(fn) AS BIGINT) AS fn, sum(tp) / nullif(sum(tp) + sum(fp), 0) AS precision,
  sum(tp) / nullif(sum(tp) + sum(fn), 0) AS recall
FROM a GROUP BY ROLLUP (parse_path)""")
def q_reply_label_agreement(spark, sf_dir):
    """E-26 / H-05: parsed simple-mode labels vs the stand-in model's intended labels, per parse path."""
    replies = scorer.simulated_replies(detected_docs(spark, sf_dir), "simple")
    intended = F.filter("PIIs", lambda d: _draw("keep", 10, F.col("doc_id"), d) < 7)
    p = replies_op.staged(replies, replies_op.parse_simple, "raw_response", "PIIs").select(
        "p", intended.alias("intended"))
    a = p.select("p.parse_path", replies_op.label_set_agreement(F.col("intended"), F.col("p.verified")).alias("a"))
    agg = a.rollup("parse_path").agg(
        F.count(F.lit(1)).alias("records"), F.sum("a.tp").alias("tp"), F.sum("a.fp").alias("fp"),
        F.sum("a.fn").alias("fn"))
    d = lambda x, y: F.try_divide(x.cast("double"), y)
    return agg.select("parse_path", "records", "tp", "fp", "fn",
                      d(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      d(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


# --------------------------------------------------------------------------- result records (C-01)
@register("entity_results", f"""
SELECT recordId, entityType, entityValue, verified AS result_verified, round(confidence, 4) AS result_confidence,
  reason AS result_reason, CAST(0.0 AS DOUBLE) AS result_latency_ms, 'rules_balanced' AS model_name,
  'cpu' AS model_type, '0' AS model_parameters, is_true_positive AS metadata_is_true_positive
FROM {O.entity_verdicts_sql(_GEN_ALL)} v""")
def q_entity_results(spark, sf_dir):
    """C-01/C-04: ``EntityResult`` rows of the rule verifier over the generated entity tests
    (flattened; the run timestamp is left out of the comparison)."""
    tests = datagen.generate(_seeds(spark, sf_dir), "all")
    v = verify.verify_entities(tests)
    from ..sources.sinks import entity_results
    r = entity_results(v.withColumn("metadata", F.create_map(
        F.lit("is_true_positive"), F.col("is_true_positive").cast("string"))), "rules_balanced", "cpu", "0")
    return r.select("recordId", "entityType", "entityValue",
                    F.col("result.verified").alias("result_verified"),
                    F.col("result.confidence").alias("result_confidence"),
                    F.col("result.reason").alias("result_reason"),
                    F.col("result.latencyMs").alias("result_latency_ms"),
                    F.col("model.name").alias("model_name"), F.col("model.type").alias("model_type"),
                    F.col("model.parameters").alias("model_parameters"),
                    (F.col("metadata")["is_true_positive"] == "true").alias("metadata_is_true_positive"))


@register("model_stats_approx")
def q_model_stats_approx(spark, sf_dir):
    """E-06: the same per-model stats with quantiles from a mergeable sketch; rows-only check, since
    approximate quantiles differ by engine (``sketch_quantile_check`` decides their error)."""
    return stats.model_stats(inference_log(spark, sf_dir), approx=True)


@register("sketch_quantile_check", f"""
SELECT model, prob, TRUE AS within_bound
FROM (SELECT DISTINCT model FROM {_LOG_SQL} l WHERE latency_ms IS NOT NULL), (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS prob)""")
def q_sketch_quantile_check(spark, sf_dir):
    """E-06: every sketched quantile's true rank lies within the returned error bound."""
    return quantiles.sketch_check(inference_log(spark, sf_dir), "model", "latency_ms", list(stats.PROBS), stats.SKETCH_K).select(
        "model", "prob", "within_bound")


# --------------------------------------------------------------------------- scorer plug-in (J-08)
@register("plugin_scorer_replies", f"""
SELECT doc_id, parse_path, array_to_string(verified, '|') AS verified, CAST(len(verified) AS INTEGER) AS n_verified
FROM {O.parse_simple_sql(f'''(SELECT doc_id, piis, CASE WHEN len(k) = 0 THEN 'NONE' ELSE array_to_string(k, ', ') END AS raw_response
  FROM (SELECT doc_id, piis, list_filter(piis, lambda l: contains(lower(text), lower(split_part(l, ' ', 1)))) AS k
        FROM {_DET} d) s)''')} p""")
def q_plugin_scorer_replies(spark, sf_dir):
    """J-08: a user scorer on Arrow batches (mapInPandas, built once per worker), its
    simple-mode replies parsed with Columns (P-10 ... P-15)."""
    docs = detected_docs(spark, sf_dir).select("doc_id", F.col("text").alias("input"),
                                              F.col("PIIs").alias("detected_piis"))
    scored = scorer.score_with(docs, scorer.KeywordScorer)
    p = replies_op.staged(scored, replies_op.parse_simple, "raw_response", "detected_piis")
    return p.select("doc_id", "p.parse_path", F.array_join("p.verified", "|").alias("verified"),
                    F.size("p.verified").alias("n_verified"))


# --------------------------------------------------------------------------- label-level verifier accuracy
_TRAIN_RECS = f"(SELECT recordId, input, element, is_true_positive FROM {_TRAIN_SQL} t0)"


@register("label_verification_metrics", f"""
WITH recs AS MATERIALIZED {_TRAIN_RECS},
c AS (SELECT recordId, label, verified FROM {O.verify_sql(O.detect_sql('recs', 'recordId', 'input'))} v),
agg AS (SELECT recordId, label, bool_or(verified) AS any_verified FROM c GROUP BY recordId, label),
pred AS (SELECT r.recordId, r.element AS pii, r.is_true_positive,
                CASE WHEN a.any_verified IS NOT NULL THEN a.any_verified
                     ELSE {O.label_guard_sql('r.element', 'r.input')} IS NULL END AS verified
         FROM recs r LEFT JOIN agg a ON a.recordId = r.recordId AND a.label = r.element)
SELECT pii, CAST(count_if(verified AND is_true_positive) AS BIGINT) AS tp,
  CAST(count_if(verified AND NOT is_true_positive) AS BIGINT) AS fp,
  CAST(count_if(NOT verified AND is_true_positive) AS BIGINT) AS fn,
  CAST(count_if(NOT verified AND NOT is_true_positive) AS BIGINT) AS tn,
  count_if(verified AND is_true_positive) / nullif(count_if(verified AND is_true_positive) + count_if(verified AND NOT is_true_positive), 0) AS precision,
  count_if(verified AND is_true_positive) / nullif(count_if(verified AND is_true_positive) + count_if(NOT verified AND is_true_positive), 0) AS recall,
  2 * count_if(verified AND is_true_positive) / nullif(2 * count_if(verified AND is_true_positive) + count_if(verified AND NOT is_true_positive) + count_if(NOT verified AND is_true_positive), 0) AS f1,
  count_if(verified AND NOT is_true_positive) / nullif(count_if(verified AND NOT is_true_positive) + count_if(NOT verified AND NOT is_true_positive), 0) AS fpr
FROM pred GROUP BY ROLLUP (pii)""")
def q_label_verification_metrics(spark, sf_dir):
    """J-03/J-04 at label level on ``DetectedRecord`` rows (located values first, whole-text
    guards otherwise), scored with E-12 against the generated corpus's truth per label."""
    t = training.generate_training(_seeds(spark, sf_dir))
    recs = t.select("recordId", "input", F.array("element").alias("PIIs"), "is_true_positive")
    return verify.confusion_metrics(verify.verify_labels_in_row(recs), by="pii")
