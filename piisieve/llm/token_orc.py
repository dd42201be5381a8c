"""Token-id output as ORC: run-length encoded ids, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id before they are tokenized; each task
writes one file, in which rows carry the file's number and the count of ids before them in
the file. The files are disjoint ranges of doc_id, so statistics of stripes and row groups
prune lookups by range, and the Bloom filters prune lookups by single ids; stripes are read in
parallel. Global offsets need one row per file, a few bytes each, summed by a window.

Defined cases: null texts count as empty and give the end id alone; null ids sort first; rows
with equal ids are ordered by a hash of their text; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import map_columns, scratch
from .textops import chunks
from .tokens import shared_tokenizer, tokenizer_path

END_ID = 2
CHUNK = 1 << 19
#: metadata of the files: 64 MB stripes, a row index entry each 1,000 documents
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000",
               "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        tokenizer = shared_tokenizer(path, spaces=True)
        before = 0
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK):
                ids, bounds = tokenizer.encode(chunk, end_id)
                rows = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.n), pa.array(np.full(chunk.n, part, np.int32)),
                     pa.array(before + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), rows],
                    ["doc_id", "part", "before", "n", "ids"])
                before += int(bounds[-1])
    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
          partitions: int | None = None) -> None:
    """Write columns doc_id, part, before, n (number of ids) and ids of all ``docs`` as ORC files in doc_id order."""
    keep = docs.select("doc_id", "text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    n = [partitions] if partitions else []
    ranged = keep.repartitionByRange(*n, *order).sortWithinPartitions(*order)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ranged.mapInArrow(_encode(vocabulary or tokenizer_path("byte_bpe_50k.json"), end_id),
                            f"doc_id {kind}, part int, before bigint, n bigint, ids array<int>")
    ids.write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: Column | None = None) -> DataFrame:
    """The rows written by ``write``; ``doc_ids``, a condition on doc_id, is pushed to the stripes."""
    df = spark.read.orc(path)
    return df if doc_ids is None else df.where(doc_ids)


def _digest():
    def compute(batch: pa.RecordBatch):
        column = batch.column("ids")
        values = column.values.to_numpy(zero_copy_only=False).astype("<u4")
        bounds = column.offsets.to_numpy()
        crc = [zlib.crc32(memoryview(values[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return [pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
    return compute


def starts(df: DataFrame) -> DataFrame:
    """One row per file: ``part`` and ``first``, the ids in the files before it."""
    sizes = df.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))


def report(docs: DataFrame) -> DataFrame:
    """Write all documents, read the files back; per document start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens.orc")
    write(docs, path)
    rows = map_columns(read(spark, path), ["doc_id", "part", "before"],
                       [("n_tokens", "bigint", pa.int64()), ("ids_crc32", "bigint", pa.int64())], _digest)
    # one row per written file, so at most one per shuffle partition
    return rows.join(F.broadcast(starts(read(spark, path))), "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
