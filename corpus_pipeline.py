"""A corpus pipeline over ``documents``: each stage works on all that the stage before kept.

Every stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; ``run``
writes each result as Parquet in the shared checkpoint folder and reads it back as the next
stage's documents. All but the last stage return the columns of ``documents``. Every stage first lets
the driver drop what the stage before left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from piisieve.llm import decontaminate, lines, packing, quality, simhash
from piisieve.llm.base import release, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the trained classifier reject."""
    release(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines that spread over many sources, short ones and lines without spaces too."""
    release(spark)
    return lines.deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    release(spark)
    return simhash.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages; drop documents that are mostly benchmark text."""
    release(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left along the Hilbert curve; one row per piece."""
    release(spark)
    return packing.report(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("packing", curve_packing)]

#: the trained classifier and the packing order have no SQL form; tests compare run() stage by stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
