"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/piisieve-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage without tying the result to any executor, and makes random or
    partition-dependent columns (row numbers, range boundaries) stable for later passes.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for every row: columns _c0, _c1, ... and _file, _row.

    Rows read straight from Parquet have one, their file and place in it; other rows are written
    with one first, so that later passes see the same numbers.
    """
    columns = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select(*columns, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException:          # another format, or a column of that name
            pass
    return staged(docs.select(*columns, F.lit(0).cast("bigint").alias("_file"),
                              F.monotonically_increasing_id().alias("_row")), "numbered")


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: plans, generated classes, broadcasts and shuffle files of finished jobs.

    Spark removes a job's shuffle files and broadcasts when the driver's objects for them are
    collected, which a driver with memory to spare puts off over many jobs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a document's id and text, used with the id itself to join results back.

    Rows alike in both get one key, and by then also equal results; null ids and texts hash
    like any other value.
    """
    return F.xxhash64(F.col(doc_id), F.col(text), F.lit(1))


def map_columns(df: DataFrame, columns: list[str], added: list[tuple[str, str, pa.DataType]],
                make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """Keep ``columns`` of ``df`` and append the columns that ``make()`` computes per Arrow batch.

    ``make`` runs once per task; the function it returns gets a batch with all columns of
    ``df`` and returns one array per entry (name, Spark type, Arrow type) of ``added``.
    """
    names = columns + [a[0] for a in added]
    if len(set(names)) != len(names):
        raise ValueError(f"clashing column names: {names}")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]
                       + [f"`{n}` {t}" for n, t, _ in added])
    kinds = [a[2] for a in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                new = compute(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in columns]
                    + [x.cast(k) if x.type != k else x for x, k in zip(new, kinds)], names)

    return df.mapInArrow(run, schema)
