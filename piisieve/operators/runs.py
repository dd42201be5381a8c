"""Run configuration tables (C-14, C-15, D-10, E-25).

The reference drives one process per model x variation from a shell script; here the run
matrix is a DataFrame (models exploded over variations, exclusions as an anti-join) and
run outcomes are a status column, so selection and tallies are ordinary queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_matrix(spark: SparkSession, models: list[tuple[str, str]], variations: list[str],
               exclusions: list[tuple[str, str]] = (), selected_models: str | None = None,
               selected_variations: str | None = None) -> DataFrame:
    """D-10/C-15: (model, size, variation) rows minus exclusions, filtered by comma lists.

    ``models`` are (model, size) pairs; variations are exploded per model row (no join);
    exclusions are removed with a left-anti join on (model, variation).
    """
    m = spark.createDataFrame(models, "model string, size string")
    runs = m.select("model", "size", F.explode(F.array(*[F.lit(v) for v in variations])).alias("variation"))
    if exclusions:
        ex = spark.createDataFrame(list(exclusions), "model string, variation string")
        runs = runs.join(F.broadcast(ex), ["model", "variation"], "left_anti")
    if selected_models:
        runs = runs.filter(F.array_contains(F.split(F.lit(selected_models), r"\s*,\s*"), F.col("model")))
    if selected_variations:
        runs = runs.filter(F.array_contains(F.split(F.lit(selected_variations), r"\s*,\s*"),
                                            F.col("variation")))
    return runs


def run_name(model: str = "model", size: str = "size", quantize: str = "quantize",
             disable_quant: str = "disable_quantization", vllm: str = "use_vllm",
             reasoning: str = "reasoning"):
    """C-14: ``{model}_{size}`` + '_4bit' (only without vLLM and not disabled) + '_vllm' +
    '_reasoning', in that order."""
    q4 = F.col(quantize) & ~F.col(disable_quant) & ~F.col(vllm)
    return F.concat(F.col(model), F.lit("_"), F.col(size),
                    F.when(q4, F.lit("_4bit")).otherwise(F.lit("")),
                    F.when(F.col(vllm), F.lit("_vllm")).otherwise(F.lit("")),
                    F.when(F.col(reasoning), F.lit("_reasoning")).otherwise(F.lit("")))


def run_tally(runs: DataFrame, status_col: str = "status", name_col: str = "run") -> DataFrame:
    """E-25: success/failure counts and the (bounded) list of failed runs."""
    return runs.agg(
        F.count_if(F.col(status_col) == "success").alias("succeeded"),
        F.count_if(F.col(status_col) != "success").alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col(status_col) != "success", F.col(name_col))))
         .alias("failed_runs"))
