"""Structured Streaming twins (L-01 ... L-03).

L-01 verifies JSONL files as they land in a folder and appends results; L-02 keeps
per-model verification and latency stats over event-time windows with a watermark; L-03
keeps one result per (record, model). The transformations are the batch operators: only
the source, the sink and the state handling differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import py_strip
from ..operators.replies import strict_json, verify_records
from ..operators.verify import verify_entities
from ..sources.jsonl import DETECTED_RECORD, ENTITY_RECORD


def verify_entity_stream(spark: SparkSession, in_dir: str, window: int = 60) -> DataFrame:
    """L-01 source + transform: tolerant JSONL entity records -> rule verdicts (stateless)."""
    lines = spark.readStream.format("text").load(in_dir)
    line = py_strip(F.col("value"))
    keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    ok = (line != "") & strict_json(line).isNotNull() \
        & F.array_contains(keys, "recordId") & F.array_contains(keys, "input")
    recs = lines.filter(ok).select(F.from_json(line, ENTITY_RECORD).alias("r")).select("r.*")
    verdicts = verify_entities(recs, window=window)
    return verdicts.select("recordId", "input", "entityType", "entityValue", "metadata",
                           "verified", "confidence", "reason",
                           F.current_timestamp().alias("ts"))


def start_with_dead_letters(spark: SparkSession, in_dir: str, out_dir: str, dead_letter_dir: str,
                            checkpoint: str, window: int = 60,
                            available_now: bool = True) -> StreamingQuery:
    """L-01 with the reject channel (A-02/B-02): each micro-batch writes verdicts for valid
    lines and the rejected lines with their reason. Both sinks are partitioned by the batch
    id and overwritten per partition, so a replayed batch (after a failure) rewrites the
    same files instead of appending duplicates."""
    lines = spark.readStream.format("text").load(in_dir)
    line = py_strip(F.col("value"))
    keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    reason = (F.when(line == "", F.lit("blank"))
              .when(strict_json(line).isNull(), F.lit("invalid_json"))
              .when(~F.array_contains(keys, "recordId"), F.lit("missing_recordId"))
              .when(~F.array_contains(keys, "input"), F.lit("missing_input")))
    tagged = lines.select(F.col("value").alias("raw_line"), line.alias("line"), reason.alias("reject_reason"))

    def write_batch(batch: DataFrame, epoch: int) -> None:
        b = batch.withColumn("batch_id", F.lit(epoch))
        good = (b.filter(F.col("reject_reason").isNull())
                .select("batch_id", F.from_json("line", ENTITY_RECORD).alias("r")).select("batch_id", "r.*"))
        verdicts = verify_entities(good, window=window).select(
            "batch_id", "recordId", "input", "entityType", "entityValue", "metadata",
            "verified", "confidence", "reason")
        opts = {"partitionOverwriteMode": "dynamic"}
        verdicts.write.mode("overwrite").options(**opts).partitionBy("batch_id").json(out_dir)
        (b.filter(F.col("reject_reason").isNotNull() & (F.col("reject_reason") != "blank"))
         .select("batch_id", "raw_line", "reject_reason")
         .write.mode("overwrite").options(**opts).partitionBy("batch_id").json(dead_letter_dir))

    w = tagged.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_batch_verification(spark: SparkSession, in_dir: str, out_dir: str, dead_letter_dir: str, checkpoint: str,
                             factory, model: str, mode: str = "simple", available_now: bool = True) -> StreamingQuery:
    """L-01 for batch records (``recordId, input, PIIs``): each micro-batch goes through the batch operators.

    Records without labels short-circuit; the others are scored and their replies parsed
    (``replies.verify_records``). Results and rejected lines are partitioned by the batch id and overwritten
    per partition, so a replayed batch rewrites its own files.
    """
    lines = spark.readStream.format("text").load(in_dir)
    line = py_strip(F.col("value"))
    keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    reason = F.when(strict_json(line).isNull(), F.lit("invalid_json"))
    for key in ("recordId", "input", "PIIs"):
        reason = reason.when(~F.array_contains(keys, key), F.lit(f"missing_{key}"))
    tagged = lines.where(line != "").select(F.col("value").alias("raw_line"), line.alias("line"), reason.alias("reject_reason"))

    def write_batch(batch: DataFrame, epoch: int) -> None:
        opts = {"partitionOverwriteMode": "dynamic"}
        good = batch.where("reject_reason IS NULL").select(F.from_json("line", DETECTED_RECORD).alias("r")).select("r.*")
        (verify_records(good, factory, model, mode).withColumn("batch_id", F.lit(epoch))
         .write.mode("overwrite").options(**opts).option("ignoreNullFields", False).partitionBy("batch_id").json(out_dir))
        (batch.where("reject_reason IS NOT NULL").select("raw_line", "reject_reason", F.lit(epoch).alias("batch_id"))
         .write.mode("overwrite").options(**opts).partitionBy("batch_id").json(dead_letter_dir))

    w = tagged.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_append(df: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True,
                 fmt: str = "json") -> StreamingQuery:
    """L-01 sink: append files, exactly-once through the checkpoint folder."""
    w = (df.writeStream.format(fmt).outputMode("append").option("path", out_dir)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def windowed_stats_stream(results: DataFrame, every: str = "1 hour", watermark: str = "10 minutes",
                          model_col: str = "model") -> DataFrame:
    """L-02: per tumbling window and model; rows later than the watermark are dropped.
    Streams use ``percentile_approx`` (bounded state); the batch twin is exact."""
    return (results.withWatermark("ts", watermark)
            .groupBy(F.window("ts", every).alias("w"), model_col)
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if("verified").alias("verified"),
                 F.avg("latency_ms").alias("latency_mean"),
                 F.percentile_approx("latency_ms", 0.95, 10000).alias("latency_p95"),
                 F.max("latency_ms").alias("latency_max"))
            .select(F.col("w.start").alias("window_start"), model_col, "total", "verified",
                    (F.col("verified") / F.col("total")).alias("verification_rate"),
                    "latency_mean", "latency_p95", "latency_max"))


def dedupe_results_stream(results: DataFrame, keys=("recordId", "model"),
                          watermark: str = "10 minutes") -> DataFrame:
    """L-03: first result per (record, model) within the watermark; state is bounded."""
    return results.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
