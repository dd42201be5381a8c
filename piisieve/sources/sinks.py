"""Sinks (B-01 ... B-07) and result-record builders (C-01, I-25, I-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_utc(ts: Column) -> Column:
    """I-25: ISO-8601 UTC stamp with microseconds and 'Z' (session time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def run_stamp(ts: Column) -> Column:
    """I-26: compact run stamp ``YYYYmmdd_HHMMSS``."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def entity_results(df: DataFrame, model_name: str, model_type: str, model_params: str,
                   latency_col: str | None = None) -> DataFrame:
    """C-01/C-04: ``EntityResult`` rows from verdict columns (verified, confidence, reason).

    Missing inputs take the reference defaults (entityType 'UNKNOWN', entityValue '',
    metadata {}); confidence is rounded to 4 and latency to 2 decimals.
    """
    lat = F.col(latency_col) if latency_col else F.lit(0.0)
    empty = F.create_map().cast("map<string,string>")
    if "metadata" not in df.columns:
        meta = empty
    elif isinstance(df.schema["metadata"].dataType, T.MapType):
        meta = F.coalesce(F.col("metadata"), empty.cast(df.schema["metadata"].dataType))
    else:                       # a typed struct (e.g. generator output) passes through as is
        meta = F.col("metadata")
    return df.select(
        "recordId", "input",
        F.coalesce(F.col("entityType"), F.lit("UNKNOWN")).alias("entityType"),
        F.coalesce(F.col("entityValue"), F.lit("")).alias("entityValue"),
        meta.alias("metadata"),
        F.struct(F.col("verified").alias("verified"),
                 F.round("confidence", 4).alias("confidence"),
                 F.col("reason").alias("reason"),
                 F.round(lat, 2).alias("latencyMs")).alias("result"),
        F.struct(F.lit(model_name).alias("name"), F.lit(model_type).alias("type"),
                 F.lit(model_params).alias("parameters")).alias("model"),
        iso_utc(F.current_timestamp()).alias("timestamp"))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """B-01/B-04/B-05: JSON lines, nulls written (as the reference does), UTF-8 unescaped."""
    (df.write.mode("overwrite" if overwrite else "append")
     .option("ignoreNullFields", False).json(path))


def write_with_dead_letters(df: DataFrame, path: str, dead_letter_path: str,
                            reason_col: str = "reject_reason", overwrite: bool = True) -> None:
    """B-02: good rows to ``path``, rows carrying a reason to a dead-letter sink; the run
    continues past bad records."""
    mode = "overwrite" if overwrite else "append"
    df.filter(F.col(reason_col).isNull()).drop(reason_col).write.mode(mode) \
        .option("ignoreNullFields", False).json(path)
    df.filter(F.col(reason_col).isNotNull()).write.mode(mode).json(dead_letter_path)


def write_comparison_csv(df: DataFrame, path: str, single_file: bool = False, report_header: bool = False) -> None:
    """B-03: CSV with header and standard double-quote escaping (quotes, commas and
    newlines round-trip). Every part file carries a header; ``single_file`` coalesces to
    one part — only for outputs known to be small. ``report_header`` gives the comparison table
    the columns ``Input Text,PII,{model}_Verified,{model}_Reason``, without the record id."""
    if report_header:
        df = df.drop("record_id").withColumnsRenamed({"input_text": "Input Text", "pii": "PII"})
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """B-06/B-07: results partitioned by e.g. (run_id) or (mode, model); dynamic partition
    overwrite replaces only the partitions present in ``df`` (a rerun of one model/mode
    leaves the others intact)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).option("ignoreNullFields", False).json(path))
