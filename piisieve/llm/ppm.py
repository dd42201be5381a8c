"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is its tokens (lower-cased A-Z words) joined by one space and closed by an end byte.
The trie of byte contexts up to ``ORDER`` is held as tables of (context + next byte, count),
one per order, gathered from all training documents. A byte not seen in a context escapes to
the next shorter one: each distinct byte seen there gives half a count to the escape (method
D), and bytes seen in the longer context are excluded from the shorter one's counts, at the end from
the uniform choice of 256. Contexts start at ``ORDER`` end bytes, so every count of a shorter
context is the sum over longer ones, and what exclusion removes is one join per order.

Scoring: a document's code length is the sum over its bytes of a value per (context, byte).
All values are computed in Spark for all such grams that occur; the ``HOT`` most frequent are
broadcast (a fixed bound) and summed in Arrow batches, the others are joined by key, one row
for each document and gram. Word counts of the unigram base work alike. Both bounds move
work between the two ways and change no result.

Defined cases: null and empty texts are the end alone; a null doc_id is hashed as the empty
string; rows alike score alike; without training documents every byte has 1/256 and no token is
known; an empty table gives no rows. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged
from .textops import BLANK, chunks, mix, span_hash, word_bounds, worker_state

ORDER = 5
HOT = 1 << 19
FOLDS = 10
END = 10
#: the end token's key among the word hashes
END_KEY = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64
_MERGE_ROWS = 800_000
CHUNK = 1 << 18


class Sequences:
    """Grams and word hashes of a run of documents."""

    def __init__(self, texts: list[bytes], order: int):
        pad = bytes([END]) * order
        normal = [b" ".join(t.lower().split()) for t in texts]
        data = np.frombuffer(b"".join([pad + t + bytes([END]) for t in normal]) + pad, dtype=np.uint8)
        sizes = np.fromiter(map(len, normal), np.int64, len(normal)) + 1
        grams = np.zeros(len(data) - order, dtype=_U)
        for i in range(order + 1):
            grams = (grams << _U(8)) | data[i:i + len(grams)]
        begin = np.cumsum(sizes + order) - sizes - order
        self.bounds = np.append(0, np.cumsum(sizes))
        self.grams = grams[np.arange(self.bounds[-1]) + np.repeat(begin - self.bounds[:-1], sizes)]
        start, end = word_bounds(data, BLANK)
        n_words = np.diff(np.append(np.searchsorted(start, begin), len(start)))
        self.word_bounds = np.append(0, np.cumsum(n_words + 1))
        self.words = np.insert(span_hash(data, start, end), np.cumsum(n_words), END_KEY)


def _sequences(batch: pa.RecordBatch, order: int) -> Iterator[tuple[int, int, Sequences]]:
    for chunk in chunks(batch.column("text"), CHUNK):
        raw = chunk.data.tobytes()
        yield chunk.first, chunk.n, Sequences([raw[a:b] for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist())], order)


def _count(order: int):
    """mapInArrow body: (kind, key, n, a) counts of words (0) and grams (1) in training and all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[], []]

        def merged(kind: int) -> tuple:
            keys, back = np.unique(np.concatenate([h[0] for h in held[kind]]), return_inverse=True)
            return keys, *(np.bincount(back, weights=np.concatenate([h[i] for h in held[kind]])).astype(np.int64)
                           for i in (1, 2))

        def rows(kind: int) -> pa.RecordBatch:
            keys, n, a = merged(kind)
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                                               pa.array(n), pa.array(a)], ["kind", "key", "n", "a"])

        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            for first, n, seq in _sequences(batch, order):
                own = learn[first:first + n]
                for kind, values, bounds in ((0, seq.words, seq.word_bounds), (1, seq.grams, seq.bounds)):
                    flags = np.repeat(own, np.diff(bounds))
                    keys, total = np.unique(values, return_counts=True)
                    taught, some = np.unique(values[flags], return_counts=True)
                    n_train = np.zeros(len(keys), np.int64)
                    n_train[np.searchsorted(keys, taught)] = some
                    held[kind].append((keys, n_train, total))
                    if sum(len(h[0]) for h in held[kind]) > _MERGE_ROWS:
                        held[kind] = [merged(kind)]
                        if len(held[kind][0][0]) > _MERGE_ROWS // 2:
                            yield rows(kind)
        for kind in (0, 1):
            if held[kind]:
                yield rows(kind)
    return run


def _mask(k: int) -> int:
    return (1 << 8 * k) - 1


def gram_values(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 probability of the last byte of every gram after the bytes before it.

    ``counts`` has key (order + 1 bytes, the last lowest) and n, its count in training."""
    levels = {order: counts.where("n > 0").select(F.col("key").alias("g"), "n")}
    for k in range(order - 1, -1, -1):
        levels[k] = staged(levels[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(_mask(k + 1))).alias("g"))
                           .agg(F.sum("n").alias("n")), f"order-{k}")
    state = {}
    for k in range(order, -1, -1):
        own = levels[k].select(F.shiftright("g", 8).alias("ctx"), "n", F.col("g").bitwiseAND(F.lit(_mask(k))).alias("low"))
        if k:        # what the bytes seen here count in the next shorter context
            own = own.join(levels[k - 1].select(F.col("g").alias("low"), F.col("n").alias("m")), "low")
        else:
            own = own.withColumn("m", F.lit(0).cast("bigint"))
        state[k] = own.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("n").alias("kinds"), F.sum("m").alias("ruled_out"))
    todo = counts.select("key", F.lit(0.0).alias("acc"), F.lit(0).cast("bigint").alias("ex_n"),
                         F.lit(0).cast("bigint").alias("ex_d"))
    done = []
    for k in range(order, -1, -1):
        todo = todo.withColumns({"g": F.col("key").bitwiseAND(F.lit(_mask(k + 1))),
                                 "ctx": F.shiftright("key", 8).bitwiseAND(F.lit(_mask(k)))})
        seen = staged(todo.join(levels[k], "g", "left").join(state[k], "ctx", "left"), f"values-{k}")
        total, kinds = F.col("total") - F.col("ex_n"), F.col("kinds") - F.col("ex_d")
        done.append(seen.where("n IS NOT NULL").select("key", (F.col("acc") + F.log10((F.col("n") - 0.5) / total)).alias("value")))
        todo = seen.where("n IS NULL").select(
            "key", (F.col("acc") + F.when(kinds > 0, F.log10(0.5 * kinds / total)).otherwise(0.0)).alias("acc"),
            F.coalesce("ruled_out", F.lit(0)).alias("ex_n"), F.coalesce("kinds", F.lit(0)).alias("ex_d"))
    out = todo.select("key", (F.col("acc") - F.log10(256 - F.col("ex_d"))).alias("value"))
    for part in done:
        out = out.unionByName(part)
    return out


def _hottest(values: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, values and known flags of at most ``limit`` rows, those of highest counts."""
    step = F.floor(F.log2("a") * 8)
    sizes = sorted(((r["s"], r["n"]) for r in values.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()),
                   reverse=True)
    least, total = None, 0
    for s, n in sizes:
        if total + n > limit:
            break
        least, total = s, total + n
    rows = values.where(step >= least if least is not None else F.lit(False)).select("key", "value", "known").toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["value"].to_numpy()[order], rows["known"].to_numpy()[order].astype(bool)


class HotTable:
    """Vectorised lookup by open addressing; a key not placed within a few probes counts as absent."""

    PROBES = 12

    def __init__(self, keys, values, known):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=_U)
        self.row = np.full(1 << self.bits, -1, dtype=np.int32)
        self.values, self.known = values, known
        left = np.arange(len(keys))
        for probe in range(self.PROBES):
            slot = self._slot(keys[left], probe)
            first = np.unique(slot, return_index=True)[1]
            put = first[self.row[slot[first]] < 0]
            self.keys[slot[put]], self.row[slot[put]] = keys[left[put]], left[put]
            left = np.delete(left, put)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((mix(keys) >> _U(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if absent."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for probe in range(self.PROBES):
            slot = self._slot(keys[left], probe)
            hit = (self.row[slot] >= 0) & (self.keys[slot] == keys[left])
            out[left[hit]] = self.row[slot[hit]]
            left = left[~hit & (self.row[slot] >= 0)]
            if not len(left):
                break
        return out


def _score(order: int, tables, tag: str):
    """mapInArrow body: a row per document with sums over hot keys (kind -1), and a row for each
    other key of it (kind 0 or 1, with its count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        state = worker_state("ppm")
        if tag not in state:
            state.clear()
            state[tag] = [HotTable(*t) for t in tables.value]
        row = TaskContext.get().partitionId() << 40
        names = ["row", "kind", "key", "count", "doc_id", "learn", "n_tokens", "n_known", "base", "score"]
        for batch in batches:
            for first, n, seq in _sequences(batch, order):
                sums, known, rest = [], None, []
                for kind, keys, bounds in ((0, seq.words, seq.word_bounds), (1, seq.grams, seq.bounds)):
                    table = state[tag][kind]
                    at = table.rows(keys)
                    hit = at >= 0
                    value = np.zeros(len(keys))
                    value[hit] = table.values[at[hit]]
                    sums.append(np.add.reduceat(value, bounds[:-1]))
                    if kind == 0:
                        flag = np.zeros(len(keys), np.int64)
                        flag[hit] = table.known[at[hit]]
                        known = np.add.reduceat(flag, bounds[:-1])
                    owner = np.repeat(np.arange(n), np.diff(bounds))[~hit]
                    left = keys[~hit]
                    sort = np.lexsort((left, owner))
                    owner, left = owner[sort], left[sort]
                    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (left[1:] != left[:-1]))) if len(left) else owner
                    rest.append((kind, row + owner[new], left[new], np.diff(np.append(new, len(left)))))
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), pa.array(np.full(n, -1, np.int32)), none, none,
                     batch.column("doc_id").slice(first, n), batch.column("learn").slice(first, n),
                     pa.array(np.diff(seq.word_bounds), pa.int64()), pa.array(known), pa.array(sums[0]), pa.array(sums[1])], names)
                for kind, owner, left, count in rest:
                    k = len(owner)
                    if k:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(owner), pa.array(np.full(k, kind, np.int32)), pa.array(left.view(np.int64)),
                             pa.array(count, pa.int64()), pa.nulls(k, batch.column("doc_id").type), pa.nulls(k, pa.bool_()),
                             pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()),
                             pa.nulls(k, pa.float64())], names)
                row += n
    return run


def scored(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10, unigram
    words) and score (log10 probability of the byte sequence under the trie)."""
    spark = docs.sparkSession
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds != 0
    rows = docs.select("doc_id", "text", learn.alias("learn"))
    counts = staged(rows.select("text", "learn").mapInArrow(_count(order), "kind int, key bigint, n bigint, a bigint")
                    .groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("a").alias("a")), "counts")
    words, grams = counts.where("kind = 0"), counts.where("kind = 1").select("key", "n", "a")
    size = words.where("n > 0").agg(F.sum("n").alias("n"), F.count("n").alias("v")).first()
    n_all, n_kinds = size["n"] or 0, size["v"]
    word_values = words.select(F.lit(0).alias("kind"), "key", F.log10((F.col("n") + 0.1) / (n_all + 0.1 * (n_kinds + 1))).alias("value"),
                               (F.col("n") > 0).alias("known"), "a")
    byte_values = gram_values(grams, order).join(grams, "key").select(
        F.lit(1).alias("kind"), "key", "value", F.lit(False).alias("known"), "a")
    values = staged(word_values.unionByName(byte_values), "values")
    tables = spark.sparkContext.broadcast([_hottest(values.where(F.col("kind") == k), hot) for k in (0, 1)])
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = staged(rows.mapInArrow(_score(order, tables, f"{id(tables)}-{counts.inputFiles()[:1]}"),
                                   f"row bigint, kind int, key bigint, count bigint, doc_id {kind}, learn boolean, "
                                   "n_tokens bigint, n_known bigint, base double, score double"), "scores")
    rest = found.where("kind >= 0").select("row", "kind", "key", "count").join(values, ["kind", "key"])
    word, c = F.col("kind") == 0, F.col("count")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(word & F.col("known"), c).otherwise(0)).alias("n_known"),
        F.sum(F.when(word, c * F.col("value")).otherwise(0.0)).alias("base"),
        F.sum(F.when(word, 0.0).otherwise(c * F.col("value"))).alias("score"))
    out = found.where("kind < 0").alias("d").join(rest.alias("r"), "row", "left")
    plus = lambda name, zero: F.col(f"d.{name}") + F.coalesce(F.col(f"r.{name}"), F.lit(zero))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", plus("n_known", 0).alias("n_known"),
                      F.lit(n_all).cast("bigint").alias("train_tokens"), plus("base", 0.0).alias("base_score"),
                      plus("score", 0.0).alias("score"))
