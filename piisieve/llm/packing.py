"""Packing along a space-filling curve.

Each document's token ids are counted into a hashed vector, scaled to length one and projected
by random signs to ``AXES`` coordinates; their ranks under the normal curve give the cell of a
Hilbert curve. Documents are range-sorted by Hilbert key (then id), laid end to end in that
order and cut every ``LENGTH`` ids, so neighbours on the curve share sequences and only the
last sequence is padded. Cuts fall anywhere; each id lies in exactly one piece.

Only keys and sizes are range-sorted. Running sums are per sorted partition, with one row per
partition summed by a window; documents get their place by a join on a row number, so copies
with one Hilbert key, however many, spread over partitions by their ids.

Defined cases: null and empty texts are the end id alone; rows alike are packed each; null ids
sort first; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import staged
from .textops import chunks, mix
from .tokens import shared_tokenizer, tokenizer_path

LENGTH = 2048
END_ID = 1
SLOTS = 256
AXES = 4
BITS = 8
CHUNK = 1 << 19


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (n x axes, below 2 ** bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):           # undo the curve's turns, from the largest cube down
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
    for i in range(1, n):                          # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _signs() -> np.ndarray:
    seeds = mix(np.arange(1, SLOTS * AXES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(seeds >> np.uint64(63), 1.0, -1.0).reshape(SLOTS, AXES)


def curve_keys(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its token ids."""
    n = len(bounds) - 1
    slot = (mix(ids.astype(np.uint64) + np.uint64(17)) % np.uint64(SLOTS)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    vectors = np.bincount(owner * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS).astype(np.float64)
    vectors /= np.maximum(1e-12, np.sqrt((vectors * vectors).sum(axis=1)))[:, None]
    # products in a fixed order: the key must not depend on how many documents a batch holds
    spots = np.stack([(vectors * axis).sum(axis=1) for axis in _signs().T], axis=1)
    share = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))), otypes=[float])(spots)
    return hilbert_key(np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        tokenizer = shared_tokenizer(path, spaces=False)
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK):
                ids, bounds = tokenizer.encode(chunk, end_id)
                raw = pa.BinaryArray.from_buffers(pa.binary(), chunk.n,
                                                  [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.n), pa.array(row + np.arange(chunk.n)),
                     pa.array(curve_keys(ids, bounds)), pa.array(np.diff(bounds), pa.int64()), raw],
                    ["doc_id", "row", "curve", "n", "ids"])
                row += chunk.n
    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        after = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int32)),
                                          pa.array(after - n, pa.int64()), pa.array(after, pa.int64())],
                                         ["row", "part", "before", "after"])
        before = int(after[-1]) if len(after) else before


def encoded(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Staged: doc_id, row (unique), curve (Hilbert key), n, ids (little-endian 16-bit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.select("doc_id", "text").mapInArrow(
        _encode(vocabulary or tokenizer_path("word_bpe_49k.json"), end_id),
        f"doc_id {kind}, row bigint, curve bigint, n bigint, ids binary"), "encoded")


def placed(ids: DataFrame) -> DataFrame:
    """(row, place): ids before each document in curve order."""
    order = ["curve", "doc_id", "row"]
    part = staged(ids.select("curve", "doc_id", "row", "n").repartitionByRange(*order)
                  .sortWithinPartitions(*order).select("row", "n")
                  .mapInArrow(_running, "row bigint, part int, before bigint, after bigint"), "curve-order")
    sizes = part.groupBy("part").agg(F.max("after").alias("total"))
    first = sizes.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    # one row per sorted partition
    return part.join(F.broadcast(first), "part").select("row", (F.col("first") + F.col("before")).alias("place"))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["at", "start", "length", "crc", "sequence", "offset", "piece"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            place = batch.column("place").to_pylist()
            for i, (raw, at) in enumerate(zip(batch.column("ids"), place)):
                ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + length - (at + a) % length)
                    piece = ids[a:b].tobytes()
                    for column, x in zip(out, (i, a, b - a, zlib.crc32(piece), (at + a) // length, (at + a) % length,
                                               piece)):
                        column.append(x)
                    a = b
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.int64()), batch.column("n").take(take), pa.array(out[4], pa.int64()),
                 pa.array(out[5], pa.int64()), pa.array(out[6], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    return run


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """All pieces with their ids (little-endian unsigned 32-bit): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, ids."""
    ids = encoded(docs, vocabulary, end_id)
    rows = ids.select("doc_id", "row", "n", "ids").join(staged(placed(ids), "places"), "row")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "place", "n", "ids").mapInArrow(
        _cut(length), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                      "sequence_id bigint, offset bigint, ids binary")


def report(docs: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return packed(docs).drop("ids")
