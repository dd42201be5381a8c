"""Verifier statistics (E-01 ... E-11), rankings (G-01 ... G-04) and batching (F-01 ... F-04).

Input is the normalised long result view ``(model, record_id, latency_ms, confidence,
verified, ts[, file_order])``. Counts, means and extremes are one ``groupBy(model)`` with partial
aggregation; quantiles come from ``quantiles``: exact by rank selection, or with ``approx=True``
(E-06) from a sketch whose rank error is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, staged
from .quantiles import exact_quantiles, rank_error, sketch_quantiles

PROBS = (0.5, 0.95, 0.99)
LATENCY_DP, CONFIDENCE_DP = 2, 4  # decimals kept by result records (round 2 / round 4)
SKETCH_K = 1600
_SLICES = 256


def exact_mean(col: str, decimals: int) -> Column:
    """Mean of values that carry ``decimals`` decimals, identical across engines.

    The sum of such values is itself a ``decimals``-place number; rounding the floating
    sum to ``decimals + 2`` places removes summation-order noise, and the final division is
    a single IEEE operation that every engine performs alike.
    """
    return F.round(F.sum(col), decimals + 2) / F.count(col)


def inference_log_from_events(events: DataFrame) -> DataFrame:
    """Stand-in inference log from the ``events`` table.

    model = event_type, latency_ms = value, confidence = props.k / 100,
    verified = confidence >= 0.5, record_id = event_id.
    """
    conf = F.get_json_object("props", "$.k").cast("double") / 100.0
    return events.select(
        F.col("event_type").alias("model"), F.col("event_id").alias("record_id"),
        F.round("value", 2).alias("latency_ms"), F.round(conf, 4).alias("confidence"),
        (conf >= 0.5).alias("verified"), F.col("ts"))


def keep_latest_file(results: DataFrame, model_col: str = "model",
                     file_col: str = "file_order") -> DataFrame:
    """E-09: when a model appears in several files, the last file replaces earlier ones.

    The per-model maximum is a tiny aggregate; the join back is left to AQE (broadcast
    when the measured side is small, sort-merge otherwise).
    """
    latest = results.groupBy(model_col).agg(F.max(file_col).alias("_latest"))
    return (results.join(latest, model_col)
            .filter(F.col(file_col) == F.col("_latest")).drop("_latest"))


def file_stats(results: DataFrame, file_col: str = "file", order_col: str = "load_order") -> DataFrame:
    """E-09/E-10: statistics per model from result files; a model's last file replaces its earlier ones.

    ``results`` is ``sources.jsonl.read_entity_results``. A file's model is that of its first row. All is
    aggregated per file; of the files of one model the last is then picked among one row per
    file, so no result row meets another table. Counts and quantiles take several passes over the
    rows, so those are parsed once and kept in the checkpoint folder.
    """
    results = staged(results.select(*dict.fromkeys([file_col, order_col, "file_name", "model", "latency_ms", "confidence",
                                                    "verified", "ts"])), "result-rows")
    per_file = model_stats(results, file_col)
    info = results.groupBy(F.col(file_col).alias("_file")).agg(
        F.min_by("model", order_col).alias("_model"), F.min("file_name").alias("file_name"))
    rows = per_file.join(info, per_file[file_col] == info["_file"]).drop("_file")
    values = [c for c in rows.columns if c != "_model"]
    last = rows.groupBy(F.struct("_model.name").alias("_name")).agg(
        F.max_by(F.struct("_model", *values), file_col).alias("_row"))
    return last.select(F.col("_name.name").alias("model"), F.col("_row._model.type").alias("model_type"),
                       F.col("_row._model.parameters").alias("model_params"),
                       *[F.col(f"_row.{c}") for c in values if c != file_col])


def exact_pct(x: Column, decimals: int) -> Column:
    """An interpolated percentile of ``decimals``-place values has at most ``decimals + 2``
    exact decimals (the interpolation fraction has two); rounding to ``decimals + 4`` removes
    engine-specific operation-order noise without touching the value."""
    return F.round(x, decimals + 4)


def _with_quantiles(agg: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """``agg`` with the quantile columns of the same group; null keys are a group of their own."""
    on = F.lit(True)
    for k in keys:
        on = on & agg[k].eqNullSafe(quantiles[k])
    return agg.join(quantiles, on, "left").select(*[agg[c] for c in agg.columns],
                                                  *[quantiles[c] for c in quantiles.columns if c not in keys])


def model_stats(results: DataFrame, model_col: str | None = "model", approx: bool = False,
                error_col: str | None = None, sketch_k: int = SKETCH_K) -> DataFrame:
    """E-01 ... E-08 per model: counts, rate, latency/confidence summaries, throughput.

    ``model_col=None`` aggregates the whole input into one row (also when it is empty).
    ``error_col`` (E-03): rows where it is not NULL (a reject reason or a fallback parse
    path) are counted as ``error_count``. With ``approx`` quantiles come from a sketch, and
    ``rank_error`` bounds how far, as a share of the rows, their ranks may be off.
    """
    lat, conf = F.col("latency_ms"), F.col("confidence")
    keys = [model_col] if model_col else []
    agg = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("verified").alias("verified"),
        F.count_if(~F.col("verified")).alias("rejected"),
        exact_mean("latency_ms", LATENCY_DP).alias("latency_mean"),
        F.min(lat).alias("latency_min"), F.max(lat).alias("latency_max"),
        exact_mean("confidence", CONFIDENCE_DP).alias("confidence_mean"),
        F.min(conf).alias("confidence_min"), F.max(conf).alias("confidence_max"),
        F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))").alias("_span_us"),
        *([F.count_if(F.col(error_col).isNotNull()).alias("error_count")] if error_col else []),
        *([sketch_quantiles("latency_ms", list(PROBS), sketch_k).alias("latency_ms_q"),
           sketch_quantiles("confidence", [0.5], sketch_k).alias("confidence_q")] if approx else []))
    if not approx:
        agg = _with_quantiles(agg, exact_quantiles(results, keys, {"latency_ms": list(PROBS), "confidence": [0.5]}), keys)
    secs = F.coalesce(F.col("_span_us") / F.lit(1e6), F.lit(0.0))
    lat_q = [exact_pct(F.get("latency_ms_q", F.lit(i)), LATENCY_DP) for i in range(len(PROBS))]
    return agg.select(
        *keys, "total", "verified", "rejected",
        F.coalesce(F.try_divide(F.col("verified").cast("double"), F.col("total")),
                   F.lit(0.0)).alias("verification_rate"),
        "latency_mean", lat_q[0].alias("latency_median"), lat_q[0].alias("latency_p50"),
        lat_q[1].alias("latency_p95"), lat_q[2].alias("latency_p99"),
        "latency_min", "latency_max",
        "confidence_mean",
        exact_pct(F.get("confidence_q", F.lit(0)), CONFIDENCE_DP).alias("confidence_median"),
        "confidence_min", "confidence_max",
        secs.alias("total_time_sec"),
        F.when(secs > 0, F.col("total") / secs).otherwise(F.lit(0.0)).alias("items_per_sec"),
        *([F.lit(rank_error(sketch_k)).alias("rank_error")] if approx else []),
        *(["error_count"] if error_col else []))


def overall_stats(results: DataFrame) -> DataFrame:
    """E-11: one-row summary of a whole run; every field is 0 when there are no rows."""
    s = model_stats(results, None)
    empty_safe = [F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in s.dtypes]
    return s.select(*empty_safe)


def best_performers(stats: DataFrame, model_col: str = "model") -> DataFrame:
    """G-02 ... G-04 in one row; ties broken by model name."""
    return stats.agg(
        F.min_by(model_col, F.struct("latency_p95", model_col)).alias("fastest_model"),
        F.min("latency_p95").alias("fastest_p95"),
        F.min_by(model_col, F.struct(-F.col("confidence_mean"), F.col(model_col)))
         .alias("most_confident_model"),
        F.max("confidence_mean").alias("highest_confidence_mean"),
        F.min_by(model_col, F.struct("verification_rate", model_col))
         .alias("most_selective_model"),
        F.min("verification_rate").alias("lowest_verification_rate"))


def comparison_table(stats: DataFrame, model_col: str = "model") -> DataFrame:
    """G-01: models ordered by p95 latency (ties by name)."""
    return stats.orderBy("latency_p95", model_col)


def sequence_number(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    out: str = "seq", num_partitions: int | None = None) -> DataFrame:
    """1-based row number within ``group_cols`` ordered by ``order_cols``, without a hot task.

    ``row_number() OVER (PARTITION BY model ...)`` puts a whole model in one task. Where the first order
    column is a number, date or timestamp, a group is cut into 256 even slices between its smallest and
    largest value, each slice into 256 again; rows are numbered within a slice of a slice, and
    counts of the slices (at most 65,536 rows a group) give its offset. Slices depend on the values alone, so nothing
    is computed before the query runs. Other types go through range partitions, numbered once and
    kept in the checkpoint folder. ``order_cols`` must make the order total (end with a unique key).
    """
    kind = dict(df.dtypes)[order_cols[0]]
    if kind in ("timestamp", "timestamp_ntz"):
        place = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(`{order_cols[0]}` as timestamp_ntz))")
    elif kind == "date":
        place = F.unix_date(order_cols[0])
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        place = F.col(f"`{order_cols[0]}`")
    else:
        return _numbered_ranges(df, group_cols, order_cols, out, num_partitions)
    place = F.coalesce(place.cast("double"), F.lit(float("-inf")))       # nulls come first
    slice_of = lambda lo, hi: F.when(
        (F.col("_x") > lo) & (hi < float("inf")) & (lo > float("-inf")),
        F.floor((F.col("_x") - lo) / (hi - lo) * (_SLICES - 1)).cast("int")).otherwise(
            F.when(F.col("_x") > lo, F.lit(1)).otherwise(F.lit(0)))
    # the group as one struct: its null fields compare as equal in joins
    rows = df.withColumn("_g", F.struct(*[F.col(f"`{c}`") for c in group_cols], F.lit(0).alias("_"))).withColumn("_x", place)
    ends = (F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    rows = rows.join(rows.groupBy("_g").agg(*ends), "_g").withColumn("_s1", slice_of(lo, hi)).drop("_lo", "_hi")
    rows = rows.join(rows.groupBy("_g", "_s1").agg(*ends), ["_g", "_s1"]).withColumn("_s2", slice_of(lo, hi)).drop("_lo", "_hi")
    earlier = Window.partitionBy("_g").orderBy("_s1", "_s2").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_g", "_s1", "_s2").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_g", "_s1", "_s2", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    if num_partitions:
        rows = rows.repartition(num_partitions, "_g", "_s1", "_s2")
    own = Window.partitionBy("_g", "_s1", "_s2").orderBy(*[F.col(f"`{c}`") for c in order_cols])
    # both sides are dealt and sorted by the slices already, so merging them costs no shuffle of the rows
    return (rows.withColumn("_local", F.row_number().over(own)).join(offsets.hint("merge"), ["_g", "_s1", "_s2"])
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_offset") + F.col("_local")).alias(out)))


def _numbered_ranges(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str,
                     num_partitions: int | None) -> DataFrame:
    """``sequence_number`` for order columns without a distance: range partitions, checkpointed."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    ranged = (df.withColumn("_g", F.struct(*[F.col(f"`{c}`") for c in group_cols], F.lit(0).alias("_")))
              .repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              # position inside the sorted partition (low 33 bits of the generated id)
              .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # Fix the numbering once: both branches below must see the same partitions and order,
    # and a reliable checkpoint also survives executor loss.
    ranged = cut_lineage(ranged)
    slices = ranged.groupBy("_pid", "_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_pid", "_g", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    return (ranged.join(offsets, ["_pid", "_g"])
            .withColumn(out, F.col("_offset") + F.col("_local") - F.col("_first") + 1)
            .drop("_pid", "_g", "_local", "_first", "_offset"))


def assign_batches(df: DataFrame, batch_size: int, group_cols: list[str],
                   order_cols: list[str]) -> DataFrame:
    """F-01: fixed-size batches in sequence order (last batch may be short)."""
    seq = sequence_number(df, group_cols, order_cols)
    return seq.withColumn("batch_id", F.floor((F.col("seq") - 1) / batch_size).cast("bigint"))


def batch_latency(batched: DataFrame, group_cols: list[str], latency_col: str = "latency_ms",
                  decimals: int = LATENCY_DP) -> DataFrame:
    """F-04: per batch, batch time (sum of item times) and per-item latency = time / size."""
    return (batched.groupBy(*group_cols, "batch_id").agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.round(F.sum(latency_col), decimals + 2).alias("batch_ms"))
        .withColumn("per_item_ms", F.col("batch_ms") / F.col("batch_size")))


def windowed_stats(results: DataFrame, every: str = "1 hour", model_col: str = "model") -> DataFrame:
    """L-02 batch twin: per tumbling window and model, counts, rate and latency summary."""
    rows = results.withColumn("w", F.window("ts", every))
    keys = ["w", model_col]
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("verified").alias("verified"),
        exact_mean("latency_ms", LATENCY_DP).alias("latency_mean"),
        F.max("latency_ms").alias("latency_max"))
    return _with_quantiles(agg, exact_quantiles(rows, keys, {"latency_ms": [0.95]}), keys).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        model_col, "total", "verified",
        (F.col("verified") / F.col("total")).alias("verification_rate"),
        "latency_mean", exact_pct(F.get("latency_ms_q", F.lit(0)), LATENCY_DP).alias("latency_p95"), "latency_max")


def first_model_info(results: DataFrame, group_col: str = "model_tag", order_col: str = "load_order",
                     info_cols: tuple[str, ...] = ("name", "type", "parameters")) -> DataFrame:
    """E-10: model name/type/parameters from the first result row of each file (or group)."""
    info = F.min_by(F.struct(*[F.col(c) for c in info_cols]), order_col).alias("info")
    return results.groupBy(group_col).agg(info).select(group_col, "info.*")


def summary_lines(stats: DataFrame) -> DataFrame:
    """E-11/I-18: the human summary of a stats row as formatted strings (one row per model)."""
    key = [c for c in stats.columns if c not in _STAT_FIELDS][:1]
    pct = lambda c: F.concat(F.format_string("%.1f", F.col(c) * 100), F.lit("%"))
    return stats.select(*key,
        F.format_string("Total Processed: %d", "total").alias("total_line"),
        F.concat(F.format_string("Verified: %d (", "verified"), pct("verification_rate"), F.lit(")"))
         .alias("verified_line"),
        F.format_string("Latency: mean %.2fms, p50 %.2fms, p95 %.2fms, p99 %.2fms", "latency_mean",
                        "latency_p50", "latency_p95", "latency_p99").alias("latency_line"),
        F.format_string("Confidence: mean %.3f, median %.3f", "confidence_mean",
                        "confidence_median").alias("confidence_line"),
        F.format_string("Throughput: %.2fs, %.2f items/s", "total_time_sec", "items_per_sec")
         .alias("throughput_line"))


_STAT_FIELDS = {"total", "verified", "rejected", "verification_rate", "latency_mean", "latency_median",
                "latency_p50", "latency_p95", "latency_p99", "latency_min", "latency_max",
                "confidence_mean", "confidence_median", "confidence_min", "confidence_max",
                "total_time_sec", "items_per_sec", "rank_error", "error_count"}
