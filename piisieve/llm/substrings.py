"""Substring dedup by anchored phrases and counted windows, in place of a relative Lempel-Ziv parse.

Documents are factored against every text of the corpus that could share a factor with them,
found by content: each window of ``WINDOW`` words names its smallest ``SEED``-word hash as its
anchor, so equal windows, wherever they are, name equal anchors. The words under the windows of
one anchor are a *phrase*; the phrases of an anchor, hash-partitioned, are a block of reference.
An anchor that occurs once in the corpus ends every factor. Where all phrases of an anchor are
equal, the factor goes on through the whole phrase, as in a greedy parse. Elsewhere a factor
starts or ends inside the phrase, and the boundary is checked window by window against the
other phrases of that anchor. Factors of ``WINDOW`` words or more become duplicate spans: exactly
the windows whose words also start anywhere else.

About one word in ten is an anchor. Anchors are counted by an aggregation; only those that
occur again travel with their documents. A bit table of fixed size (``BITS``) keeps back most
others; a bit set by chance, or a full table, sends more rows but changes no result, as
anchors are joined exactly afterwards. Hot anchors are joined against staged tables, so their
rows can be split over tasks.

Defined cases: null texts and texts under ``WINDOW`` words have no windows; windows may
overlap their own copy; repeated rows are copies of each other; an empty table gives no rows.
Words and windows compare by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_columns, row_key, staged
from .textops import BLANK, Chunk, chunks, mix, range_hash, span_hash, window_hash

WINDOW = 35
SEED = 18
BITS = 26


class Phrases:
    """The phrases of a chunk: one per anchor occurrence that some window names."""

    def __init__(self, chunk: Chunk, window: int, seed: int):
        start, end, bound = chunk.words(BLANK)
        words = span_hash(chunk.data, start, end)
        self.window, self.words, self.bound = window, words, bound
        doc = np.repeat(np.arange(chunk.n), np.diff(bound))
        n = len(words) - window + 1
        whole = np.flatnonzero(doc[:n] == doc[window - 1:]) if n > 0 else np.empty(0, np.int64)
        if not len(whole):
            self.first = self.last = self.doc = np.empty(0, np.int64)
            self.seeds = self.whole = np.empty(0, np.uint64)
            return
        seeds = window_hash(words, seed)
        spread = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)
        anchor = whole + np.concatenate([spread[whole[i:i + 65536]].argmin(axis=1)
                                         for i in range(0, len(whole), 65536)])
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[whole[1:]] != doc[whole[:-1]]))
        at = np.flatnonzero(new)
        self.first = whole[at]                                    # first and last window of each phrase
        self.last = whole[np.append(at[1:], len(whole)) - 1]
        self.doc = doc[self.first]
        self.seeds = seeds[anchor[at]]
        shape = (anchor[at] - self.first) * 64 + (self.last - self.first)
        self.whole = mix(range_hash(words, self.first, self.last + window) + shape.astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _count(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = Phrases(chunk, window, seed)
                yield pa.RecordBatch.from_arrays([_signed(found.seeds), _signed(found.whole)], ["seed", "whole"])
    return run


def _send(window: int, seed: int, tables):
    """mapInArrow body: phrases whose anchor may occur again; their window hashes where phrases differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, differ = (np.frombuffer(t, np.uint8) for t in tables.value)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = Phrases(chunk, window, seed)
                slot = (found.seeds >> np.uint64(64 - BITS)).astype(np.int64)
                bit = lambda table: (table[slot >> 3] >> (slot & 7)) & 1
                at = np.flatnonzero(bit(again)) if len(slot) else slot
                windows = window_hash(found.words, window)
                n = np.where(bit(differ)[at] == 1, found.last[at] - found.first[at] + 1, 0) if len(slot) else slot
                bounds = np.append(0, np.cumsum(n))
                pick = np.arange(bounds[-1]) + np.repeat(found.first[at] - bounds[:-1], n)
                own = pa.array(chunk.first + found.doc[at])
                base = found.bound[found.doc[at]]
                hashes = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _signed(windows[pick]))
                yield pa.RecordBatch.from_arrays(
                    [_signed(found.seeds[at]), batch.column("_key").take(own), batch.column("doc_id").take(own),
                     pa.array((found.first[at] - base).astype(np.int32)), pa.array((found.last[at] - base).astype(np.int32)),
                     hashes], ["seed", "_key", "doc_id", "first", "last", "windows"])
    return run


def _bits(seeds: DataFrame) -> bytes:
    """2 ** BITS bits, one set for each seed; at most 2 ** (BITS - 6) rows come to the driver."""
    slot = F.shiftrightunsigned("seed", 64 - BITS)
    words = seeds.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), dtype=np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    return table.tobytes()


def spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(_key, doc_id, first, end): word ranges of ``docs`` that are covered by repeated windows."""
    rows = docs.select("doc_id", "text", row_key().alias("_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = rows.select("text").mapInArrow(_count(window, seed), "seed bigint, whole bigint")
    again = staged(anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"),
                                               F.max("whole").alias("b"))
                   .where("n > 1").select("seed", (F.col("a") != F.col("b")).alias("differ")), "anchors")
    tables = docs.sparkSession.sparkContext.broadcast((_bits(again.select("seed")), _bits(again.where("differ").select("seed"))))
    sent = rows.mapInArrow(_send(window, seed, tables), f"seed bigint, _key bigint, doc_id {kind}, "
                           "first int, last int, windows array<bigint>")
    found = staged(sent.join(again, "seed").select(
        "_key", "doc_id", "first", "last", "differ", F.when(F.col("differ"), F.col("windows")).alias("windows")), "phrases")
    full = found.where("NOT differ").select("_key", "doc_id", "first", (F.col("last") + window).alias("end"))
    edge = found.where("differ").select("_key", "doc_id", "first", F.posexplode("windows").alias("i", "hash"))
    twice = staged(edge.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "windows")
    checked = edge.join(twice, "hash").select("_key", "doc_id", (F.col("first") + F.col("i")).alias("first"),
                                              (F.col("first") + F.col("i") + window).alias("end"))
    return full.unionByName(checked)


def _rewrite():
    def compute(batch: pa.RecordBatch):
        n_words, n_gone, texts = [], [], []
        cover = batch.column("_spans").to_pylist()
        for chunk in chunks(batch.column("_text")):
            start, end, bound = chunk.words(BLANK)
            raw = chunk.data.tobytes()
            for i in range(chunk.n):
                a, b = int(bound[i]), int(bound[i + 1])
                own = cover[chunk.first + i]
                gone = np.zeros(b - a + 1, dtype=np.int64)
                if own:
                    edges = np.array([(s["first"], s["end"]) for s in own])
                    np.add.at(gone, edges[:, 0], 1)
                    np.add.at(gone, edges[:, 1], -1)
                kept = a + np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                n_words.append(b - a)
                n_gone.append(b - a - len(kept))
                texts.append(b" ".join([raw[s:e] for s, e in zip(start[kept].tolist(), end[kept].tolist())]).decode())
        return [pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(texts, pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
    return compute


def deduplicated(docs: DataFrame, columns: list[str] | None = None, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``columns`` of ``docs`` with _n_words, _n_removed, _kept (kept words joined by one space)
    and _sha256 of that."""
    columns = docs.columns if columns is None else columns
    own = spans(docs, window, seed).groupBy("_key", F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.struct("first", "end")).alias("_spans"))
    keep = [f"_c{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, keep)], F.col("doc_id").alias("_doc"),
                       F.col("text").alias("_text"), row_key().alias("_own"))
    own = staged(own, "spans")
    joined = rows.join(own, (F.col("_own") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
    out = map_columns(joined.select(*keep, "_text", "_spans"), keep,
                      [("_n_words", "bigint", pa.int64()), ("_n_removed", "bigint", pa.int64()),
                       ("_kept", "string", pa.string()), ("_sha256", "string", pa.string())], _rewrite)
    return out.select(*[F.col(k).alias(c) for c, k in zip(columns, keep)], "_n_words", "_n_removed", "_kept", "_sha256")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(docs, ["doc_id"]).select("doc_id", F.col("_n_words").alias("n_words"),
                                                 F.col("_n_removed").alias("n_removed"), F.col("_sha256").alias("kept_sha256"))
