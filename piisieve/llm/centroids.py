"""Centroid clustering with equal-average equal-variance nearest-neighbour search.

Vectors become integers, floor(SCALE * x). A round assigns every vector to its nearest
centroid and moves each centroid to the floored mean of its vectors. The search keeps the
centroids sorted by component sum and scans outward from the vector's own sum. With D
components, sums S and spreads R = D * sum(x^2) - S^2 of two vectors,
D * distance >= (S1 - S2)^2 + (sqrt R1 - sqrt R2)^2: the first term ends the scan (all further
centroids lie further away in sum), both together reject a single centroid. What is left is
measured in exact integers. Bounds carry a margin for rounding, so they reject only centroids
that are strictly farther; ties go to the smaller number.

Tasks return one row of sums per centroid and task; the driver holds the centroids only
(k times D integers). Vectors never cross a shuffle, so copies of one vector, however many,
stay where they were read.

Defined cases: null vectors, other lengths, null or non-finite components: not kept; fewer kept
vectors than centroids: as many centroids as vectors; repeated rows count each, and may be
several first centroids; a null id is hashed like an empty one and comes after all others; equal
hashes are ordered by the vector; an empty centroid stays where it was; components are limited to
+-2^31 / D after scaling (+-524,288.0 before it for 64 components), so that every sum fits a long;
an empty table gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1


def _integers(dims: int, scale: int):
    """mapInArrow body: ids and integer vectors of the kept rows."""
    limit = (1 << 31) // dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            size = np.diff(lists.offsets.to_numpy())
            rows = np.flatnonzero((size == dims) & lists.is_valid().to_numpy(zero_copy_only=False))
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)     # null: not a number
            x = values[lists.offsets.to_numpy()[rows][:, None] + np.arange(dims)]
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * x[fine]), -limit, limit).astype(np.int32)
            ends = np.arange(len(q) + 1, dtype=np.int32) * dims
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows[fine], pa.int64())),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(q.reshape(-1)))], ["id", "q"])
    return run


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, q): the kept vectors as arrays of integers."""
    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).mapInArrow(
        _integers(dims, scale), f"id {kind}, q array<int>")


def first_centroids(q: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = q.orderBy(F.col("id").isNull(), key, "q").limit(k).select("q").collect()
    return np.array([r.q for r in rows], dtype=np.int64)


class Search:
    """Nearest centroid of integer vectors, with the centroids in order of their component sum."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(axis=1)
        self.number = np.argsort(total, kind="stable")
        self.at = centroids[self.number]
        self.total = total[self.number]
        self.spread = self._spread(self.at, self.total)
        self.measured = 0            # exact distances computed so far

    @staticmethod
    def _spread(x: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - total * total).astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row of ``x``."""
        n, dims = x.shape
        k = len(self.at)
        total = x.sum(axis=1)
        spread = self._spread(x, total)
        high = np.searchsorted(self.total, total)
        low = high - 1
        best = np.full(n, np.iinfo(np.int64).max)
        found = np.full(n, k)
        active = np.arange(n)
        while len(active):
            own, lo, hi = total[active], low[active], high[active]
            down = np.where(lo >= 0, (own - self.total[lo]).astype(np.float64), np.inf)
            up = np.where(hi < k, (self.total[np.minimum(hi, k - 1)] - own).astype(np.float64), np.inf)
            gap = np.minimum(down, up)
            reach = best[active].astype(np.float64) * dims
            going = np.isfinite(gap) & (gap * gap * (1 - 1e-9) <= reach)      # else: nearer ones are all measured
            active, gap, reach = active[going], gap[going], reach[going]
            left = (down <= up)[going]
            j = np.where(left, low[active], high[active])
            low[active[left]] -= 1
            high[active[~left]] += 1
            apart = np.abs(spread[active] - self.spread[j]) - 1e-9 * (spread[active] + self.spread[j])
            near = (gap * gap + np.maximum(apart, 0) ** 2) * (1 - 1e-9) <= reach
            rows, j = active[near], j[near]
            step = x[rows] - self.at[j]
            d = (step * step).sum(axis=1)
            self.measured += len(rows)
            number = self.number[j]
            better = (d < best[rows]) | ((d == best[rows]) & (number < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], number[better]
        return found, best


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def _sums(centroids: np.ndarray):
    """mapInArrow body: per task and centroid the number and the sum of its vectors."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _vectors(batch, dims)
            cluster, _ = search.nearest(x)
            order = np.argsort(cluster, kind="stable")
            size = np.bincount(cluster, minlength=k)
            some = np.flatnonzero(size)
            if len(some):
                sums[some] += np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0)
            count += size
        some = np.flatnonzero(count)
        ends = np.arange(len(some) + 1, dtype=np.int32) * dims
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[some].reshape(-1)))], ["cluster", "n", "sums"])
    return run


def moved(q: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    parts = q.mapInArrow(_sums(centroids), "cluster int, n bigint, sums array<bigint>")
    total = (parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
             .agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    out = centroids.copy()
    for r in total.collect():                  # at most k rows per component
        out[r.cluster, r.i] = r.s // r.n
    return out


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            cluster, distance = search.nearest(_vectors(batch, centroids.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])
    return run


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS,
              rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(``id_col``, cluster, distance) of every kept vector, staged, and the final centroids."""
    q = staged(integer_vectors(vectors, id_col, vector_col, dims, scale), "vectors")
    centroids = first_centroids(q, k, seed)
    kind = q.schema["id"].dataType.simpleString()
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint"), centroids
    for _ in range(rounds):
        centroids = moved(q, centroids)
    rows = q.mapInArrow(_assign(centroids), f"id {kind}, cluster int, distance bigint")
    return staged(rows.withColumnRenamed("id", id_col), "clusters"), centroids


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every kept vector with its cluster, its distance, inertias and a digest of its centroid."""
    rows, centroids = clustered(vectors, id_col, vector_col)
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.sum("distance").alias("inertia"))
    # one row per centroid
    info = (own.join(rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
            .join(F.broadcast(whole)))
    return rows.join(F.broadcast(info), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
