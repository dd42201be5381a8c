"""Reference workflow: verifier runs write JSONL results, consolidation reads them back."""

import os

from pyspark.sql import functions as F

from piisieve.operators import consolidate as C
from piisieve.plans import queries as Q
from piisieve.sources import jsonl, sinks

from conftest import SF_SMALL


def test_jsonl_round_trip_consolidation(spark, tmpdir_path):
    batch = Q.rule_batch_results(spark, SF_SMALL)
    models = [m.name for m in C.RULE_MODELS]
    paths = []
    for m in models:                                   # one result folder per model run
        out = os.path.join(tmpdir_path, m)
        sinks.write_jsonl(batch.filter(F.col("model") == m).select(
            F.col("doc_id").cast("string").alias("recordId"), F.col("input_text").alias("input"),
            "detected_piis", "verified_piis", "latency_ms", "model"), out)
        paths.append(out)
    back = jsonl.read_results(spark, paths + [os.path.join(tmpdir_path, "missing")])
    via_files = C.consolidate(C.results_long(back), models)
    direct = C.consolidate(C.results_long(batch, id_col="doc_id", input_col="input_text"), models)
    assert via_files.count() == direct.count() > 0
    assert via_files.exceptAll(direct).count() == 0
    csv = os.path.join(tmpdir_path, "comparison")
    sinks.write_comparison_csv(via_files, csv, single_file=True)
    again = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv)
    assert again.count() == direct.count()
    assert set(again.columns) == set(direct.columns)
