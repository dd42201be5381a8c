"""Quality rules: base counts and a hashed n-gram logistic regression.

The classifier sees each text as relative frequencies of hashed word 1- and 2-grams and byte
3- and 5-grams in ``DIMS`` shared slots. It is trained on at most ``sample_rows`` labelled
documents (those with the smallest hash of their id), whole texts, however long. Limited-memory BFGS
takes ``PASSES`` passes over them, each a Spark job: ``SAMPLE_TASKS`` tasks add up the loss and gradient
of their rows and the driver sums these (``DIMS`` floats each), so no task holds the whole sample. Four fifths fit the weights, one fifth fits
a Platt calibration on the driver (one score a row). The finished model (``DIMS`` floats) is broadcast;
all documents are then scored in Arrow batches against a fixed probability threshold.

Defined cases: null and empty texts have no words and fail the base rule; documents without a
label are scored like others; labels that are null are not trained on; without labels of both
classes the model keeps what the base rules keep; a label row repeated or contradicting itself
trains once, by its smallest value; a probability equal to the threshold is kept; documents alike get
the same verdict; an empty table gives no rows; further columns may have any names (``kept_documents``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_columns, staged
from .textops import BLANK, LOWER, Chunk, chunks, mix, span_hash, window_hash

BITS = 18
DIMS = 1 << BITS
SAMPLE_ROWS = 3000
#: tasks that hold a share of the sample each
SAMPLE_TASKS = 12
#: passes over the sample, pairs of moves that the curvature is taken from, and L2 weight
PASSES = 20
MEMORY = 6
DECAY = 1e-3
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
_U = np.uint64
_SYMBOL = np.array([chr(c) in "#*$%&|<>" for c in range(256)])
_KINDS = 4


def _per_doc(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range bound[i]:bound[i + 1]."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bound[1:]] - total[bound[:-1]]


def _edges(chunk: Chunk) -> np.ndarray:
    return np.append(chunk.starts, len(chunk.data))


def base_counts(chunk: Chunk):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    data = chunk.data
    start, end, bound = chunk.words(BLANK)
    n_words = np.diff(bound)
    edge = _edges(chunk)
    chars = _per_doc(BLANK[data] & ((data & 0xC0) != 0x80), edge)
    symbols = _per_doc(_SYMBOL[data], edge)

    line_start = np.flatnonzero(np.append(True, data[:-1] == 10))
    line_end = np.flatnonzero(data == 10)
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    owner = np.searchsorted(chunk.starts, line_start, side="right") - 1
    keys = mix(span_hash(data, line_start, line_end) ^ mix(owner.astype(_U) + _U(1)))
    first = np.unique(keys, return_index=True)[1]
    dup = np.bincount(owner, minlength=chunk.n) - np.bincount(owner[first], minlength=chunk.n)

    words = span_hash(data, start, end)
    windows = window_hash(words, REPEAT_WINDOW)
    doc = np.repeat(np.arange(chunk.n), n_words)
    repeats = np.zeros(chunk.n, dtype=np.int64)
    if len(windows):
        at = np.flatnonzero(doc[:len(windows)] == doc[REPEAT_WINDOW - 1:])
        keys = mix(windows[at] ^ mix(doc[at].astype(_U) + _U(1)))
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        hit = at[count[back] > 1]
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + REPEAT_WINDOW, -1)
        repeats = _per_doc(np.cumsum(cover[:-1]) > 0, bound)
    return n_words, chars, symbols, dup, repeats


def features(chunk: Chunk):
    """For each kind of n-gram: slots (int) and the document bounds into them."""
    low = LOWER[chunk.data]
    start, end, bound = chunk.words(BLANK, low)
    words = span_hash(low, start, end)
    shift = _U(64 - BITS)
    yield (mix(words + _U(11)) >> shift).astype(np.int64), bound
    pairs = mix(words[:-1] * _U(3) + words[1:] + _U(13)) if len(words) > 1 else words[:0]
    doc = np.repeat(np.arange(chunk.n), np.diff(bound))
    own = doc[:-1] == doc[1:]
    yield ((pairs[own] >> shift).astype(np.int64),
           np.append(0, np.cumsum(np.bincount(doc[:-1][own], minlength=chunk.n))))
    for width in (3, 5):
        gram = np.zeros(max(0, len(low) - width + 1), dtype=_U)
        for i in range(width):
            gram = gram * _U(257) + low[i:i + len(gram)]
        slot = ((gram + _U(width)) * _U(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
        a = chunk.starts
        b = np.maximum(a, chunk.ends - width + 1)
        inside = np.zeros(len(slot) + 1, dtype=np.int8)
        some = b > a
        inside[a[some]] += 1
        inside[b[some]] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        yield slot[inside], np.append(0, np.cumsum(b - a))


def _extract():
    """Task body: sparse features of each document (slots and relative frequencies)."""
    def compute(batch: pa.RecordBatch):
        slots, values = [], []
        for chunk in chunks(batch.column("text")):
            rows: list[list] = [[] for _ in range(chunk.n)]
            for slot, bound in features(chunk):
                for i in range(chunk.n):
                    own, count = np.unique(slot[bound[i]:bound[i + 1]], return_counts=True)
                    if len(own):
                        rows[i].append((own, count / count.sum()))
            for row in rows:
                slots.append(np.concatenate([r[0] for r in row]).astype(np.int32).tobytes() if row else b"")
                values.append(np.concatenate([r[1] for r in row]).astype(np.float32).tobytes() if row else b"")
        return [pa.array(slots, pa.binary()), pa.array(values, pa.binary())]
    return compute


def _rows(batch: pa.RecordBatch, w: np.ndarray, bias: float):
    """Slots, values and row numbers of a batch of the sample, and its scores."""
    slots, vals = batch.column("slots").to_pylist(), batch.column("vals").to_pylist()
    row = np.repeat(np.arange(len(slots), dtype=np.int32), [len(x) // 4 for x in slots])
    col = np.frombuffer(b"".join(slots), np.int32)
    val = np.frombuffer(b"".join(vals), np.float32) * np.float32(30)
    return col, val, row, np.bincount(row, weights=w[col] * val, minlength=len(slots)) + bias


def _pass(model, keys: np.ndarray, weight: np.ndarray):
    """mapInArrow body: a task's summed loss and gradient (weights, then bias), its rows' keys and scores."""
    def run(batches):
        w, loss, total, own, scores = model.value, 0.0, np.zeros(DIMS + 1), [], []
        for batch in batches:
            col, val, row, z = _rows(batch, w[:-1], w[-1])
            key, label = batch.column("key").to_numpy(), batch.column("label").to_numpy()
            share = weight[np.searchsorted(keys, key)]
            error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
            total[:-1] += np.bincount(col, weights=val * error[row], minlength=DIMS)
            total[-1] += error.sum()
            loss += float((share * (np.logaddexp(0, z) - label * z)).sum())
            own.append(key)
            scores.append(z)
        if own:
            raw = [x.tobytes() for x in (total.astype(np.float32), np.concatenate(own), np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays([pa.array([loss])] + [pa.array([x], pa.binary()) for x in raw],
                                             ["loss", "g", "keys", "z"])
    return run


def minimised(evaluate, size: int, passes: int = PASSES, memory: int = MEMORY):
    """What ``evaluate`` adds to loss and gradient at the best point that limited-memory BFGS reaches, and the point.

    ``evaluate(w)`` gives loss, gradient and anything else; it is called ``passes`` times at most. A step is
    halved until the loss falls.
    """
    w = np.zeros(size)
    loss, g, rest = evaluate(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1 / max(float(np.linalg.norm(g)), 1e-12)
    for _ in range(passes - 1):
        way, shares = -g, []
        for moved, bent in reversed(past):
            shares.append((moved @ way) / (moved @ bent))
            way = way - shares[-1] * bent
        if past:
            moved, bent = past[-1]
            way *= (moved @ bent) / (bent @ bent)
        for (moved, bent), share in zip(past, reversed(shares)):
            way += moved * (share - (bent @ way) / (moved @ bent))
        new = (w + step * way).astype(np.float32).astype(np.float64)      # as tasks see it
        at, slope, more = evaluate(new)
        if at > loss + 1e-4 * step * float(g @ way):
            step /= 2
            continue
        if (new - w) @ (slope - g) > 1e-12:
            past = [*past, (new - w, slope - g)][-memory:]
        w, loss, g, rest, step = new, at, slope, more, 1.0
    return w, rest


def _fit(sample: DataFrame) -> tuple[np.ndarray, float, float]:
    """Weights and bias, slope and offset of the sample (key, label, slots, vals)."""
    known = sorted((r["key"], r["label"]) for r in sample.select("key", "label").collect())     # at most sample_rows rows
    keys, y = np.array([k for k, _ in known], dtype=np.int64), np.array([c for _, c in known], dtype=np.float64)
    if len(set(y)) < 2:
        return np.empty(0, dtype=np.float32), 0.0, 0.0
    fit = (np.arange(len(y)) % 5) != 4
    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit
    context = sample.sparkSession.sparkContext

    def evaluate(w: np.ndarray):
        model = context.broadcast(w.astype(np.float32))
        parts = sample.mapInArrow(_pass(model, keys, weight), "loss double, g binary, keys binary, z binary").collect()
        model.destroy()
        g, z = np.append(DECAY * w[:-1], 0.0), np.zeros(len(keys))
        for p in parts:
            g += np.frombuffer(p["g"], np.float32)
            z[np.searchsorted(keys, np.frombuffer(p["keys"], np.int64))] = np.frombuffer(p["z"], np.float64)
        return sum(p["loss"] for p in parts) + DECAY / 2 * float(w[:-1] @ w[:-1]), g, z

    w, z = minimised(evaluate, DIMS + 1)
    held = ~fit if len(set(y[~fit])) == 2 else fit
    slope, offset = platt(z[held], y[held])
    return np.append(w[:-1] * 30, w[-1]).astype(np.float32), slope, offset


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from scores to probabilities (Newton's method)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, float]:
    """Weights (DIMS and a bias; empty if the sample has one class), slope and offset."""
    sample = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
              .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
              .withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(sample_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")   # at most sample_rows rows
            .groupBy("doc_id", "key", "label").agg(F.min("text").alias("text")))
    found = map_columns(rows, ["key", "label"], [("slots", "binary", pa.binary()), ("vals", "binary", pa.binary())],
                        _extract)
    spread = found.repartition(SAMPLE_TASKS, "key").sortWithinPartitions("key")
    return _fit(staged(spread, "quality-sample").coalesce(SAMPLE_TASKS))


def _scorer(model):
    def make():
        weights, slope, offset = model.value

        def compute(batch: pa.RecordBatch):
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for chunk in chunks(batch.column("_text")):
                counts = base_counts(chunk)
                z = np.full(chunk.n, weights[-1] if len(weights) else 0.0)
                for slot, bound in features(chunk) if len(weights) else ():
                    n = np.diff(bound)
                    some = n > 0
                    if some.any():
                        z[some] += np.add.reduceat(weights[slot].astype(np.float64), bound[:-1][some]) / n[some]
                p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30))) if len(weights) else np.ones(chunk.n)
                for column, x in zip(out, [*counts, p]):
                    column.append(x)
            return [pa.array(np.concatenate(x)) for x in out]
        return compute
    return make


_ADDED = [(n, "bigint", pa.int64()) for n in ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines",
                                              "_n_repeat_words")] + [("_p", "double", pa.float64())]


def _judged(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """Columns of ``docs`` as _c0, _c1, ... with base counts, ``_p``, ``_base_failed`` and ``_kept``."""
    model = docs.sparkSession.sparkContext.broadcast(train(train_docs if train_docs is not None else docs, labels))
    keep = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, keep)], F.col("text").alias("_text"))
    out = map_columns(renamed, keep, _ADDED, _scorer(model))
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words")
                                               > MAX_REPEAT_PERCENT * F.col("_n_words"))
    return out.select("*", failed.alias("_base_failed"), (~failed & (F.col("_p") >= THRESHOLD)).alias("_kept"))


def scored(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with base counts, probability ``_p`` and verdicts ``_base_failed`` and ``_kept``; columns of
    ``docs`` that have one of these names are replaced."""
    added = [a[0] for a in _ADDED] + ["_base_failed", "_kept"]
    return _judged(docs, labels, train_docs).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in added], *added)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept and the probability."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", *[F.col(a[0]).alias(a[0][1:]) for a in _ADDED[:5]],
                      F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
                      F.col("_p").alias("probability"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, unchanged."""
    return _judged(docs, labels).where("_kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
