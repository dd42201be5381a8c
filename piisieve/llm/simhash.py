"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of at most three differing bits have a common point within one bit of the one
and two bits of the other. Every distinct fingerprint emits its ball: itself, its 64 one-bit
variants, and two-bit variants. Of any three bits two lie in the same 32-bit half, so it is
enough that fingerprints of even weight flip pairs of the low half and those of odd weight
pairs of the high half (three flips change the weight's parity, so a pair at distance three
has one of each): 561 variants instead of 2,081. At most two bits apart, one-bit variants meet.

Variants are shuffled on ``KEY`` bits of their value. Those of one fingerprint that agree on
these bits travel as one row, which the receiving task expands again: 91 rows instead of 561.
Keys near which fingerprints lie so densely that they would overfill a task are dealt by the
whole variant instead, one row each; both sides of a meeting take the same way, since it
depends on the variant alone. The number of tasks follows the number of variants.

Around one variant at most 2,081 distinct fingerprints can meet, whatever the corpus holds,
so groups are bounded. All that are within one bit of the variant are true links of all others there (1 + 2 bits); the smallest of them is linked
with each other member after its distance is checked. Exact copies share a fingerprint and
meet before, in an aggregation. Links go to connected components, never to the driver.

Defined cases: null and wordless texts have fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; repeated rows share a component; a null doc_id
gets its component's smallest id, and null if there is none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_columns, numbered, row_key, staged
from .components import components
from .textops import BLANK, word_bounds

SHINGLE = 3
RADIUS = 3
SEED = 42
_ONE = [1 << i for i in range(64)]
#: flip masks of the half-radius ball by the parity of a fingerprint's weight
BALL = [[0, *_ONE, *(a | b for i, a in enumerate(half) for b in half[:i])] for half in (_ONE[:32], _ONE[32:])]
#: the bits of a variant that decide its task: 2 ** 24 keys
KEY = 0x00000FFF00000FFF
#: variants that a task sorts, about
TASK_VARIANTS = 4_000_000
#: keys with more fingerprints of their own than this are dealt by whole variants, as are their neighbours
DENSE = TASK_VARIANTS // len(BALL[0])
#: row numbers (two longs each) that are broadcast at most
BROADCAST_ROWS = 1 << 19


def _routes() -> tuple[list[list[int]], list[list[tuple[int, int, int]]]]:
    """Flips by code, and per parity (key flip, code, n): code's n flips change the key bits by key flip.

    Codes ``code + 1`` to ``code + n`` stand for the same flips one by one.
    """
    flips: list[list[int]] = []
    routes: list[list[tuple[int, int, int]]] = [[], []]
    for route, ball in zip(routes, BALL):
        by_key: dict[int, list[int]] = {}
        for mask in ball:
            by_key.setdefault(mask & KEY, []).append(mask)
        for key, masks in by_key.items():
            route.append((key, len(flips), len(masks)))
            flips += [masks, *([m] for m in masks)]
    return flips, routes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: bits set in more than half of its shingles' XXH64."""
    import xxhash
    text = b" ".join(raw.lower().split())
    start, end = word_bounds(np.frombuffer(text, np.uint8), BLANK)
    if not len(start):
        return 0
    width = min(shingle, len(start))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(text[a:b], SEED) for a, b in zip(start[:len(start) - width + 1].tolist(),
                                                                  end[width - 1:].tolist())], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _hash(shingle: int):
    def make():
        def compute(batch: pa.RecordBatch):
            return [pa.array([_signed(fingerprint(t.as_buffer().to_pybytes(), shingle)) if t.is_valid else 0
                              for t in batch.column("text")], pa.int64())]
        return compute
    return make


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``_key`` (see ``row_key``) and fingerprint ``fp`` of every row."""
    rows = docs.select("doc_id", "text", row_key().alias("_key"))
    return map_columns(rows, ["doc_id", "_key"], [("fp", "bigint", pa.int64())], _hash(shingle))


def _meet(radius: int):
    """mapInArrow body over rows sorted by variant: links between those that meet."""
    def links(variant: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        near = np.bitwise_count((variant ^ fp).view(np.uint64)) <= 1
        first = np.append(True, variant[1:] != variant[:-1])
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        hub = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(hub, group[near], fp[near])
        some = np.zeros(len(size), dtype=bool)
        some[group[near]] = True
        at = (some & (size > 1))[group]
        u, v = hub[group[at]], fp[at]
        apart = np.bitwise_count((u ^ v).view(np.uint64))
        ok = (apart > 0) & (apart <= radius)
        return pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 2
        for batch in batches:
            cols = [np.append(h, batch.column(i).to_numpy(zero_copy_only=False)) for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))      # the last group may go on
            held = [c[cut:] for c in cols]
            if cut:
                yield links(cols[0][:cut], cols[1][:cut])
        if len(held[0]):
            yield links(held[0], held[1])
    return run


def _literal(value) -> str:
    if isinstance(value, list):
        return f"array({', '.join(map(_literal, value))})"
    if isinstance(value, tuple):
        return f"struct({', '.join(map(_literal, value))})"
    return f"bigint('{_signed(value)}')"


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Links (u, v) between distinct fingerprints of at most ``radius`` (up to 3) differing bits.

    Pairs around one variant are linked through its smallest near member, so links connect
    exactly the fingerprints that pairwise links would connect. ``dense`` changes only the
    way rows travel.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the ball covers up to 3 differing bits")
    flips, routes = _routes()
    distinct = staged(fps.select("fp").where("fp IS NOT NULL").distinct(), "distinct")
    # a task's work is its variants, so their number sets that of the tasks; adaptive coalescing
    # would judge by the bytes of the rows that carry them
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                distinct.count() * len(BALL[0]) // TASK_VARIANTS)
    key = F.col("fp").bitwiseAND(F.lit(KEY))
    reach = F.expr(_literal(sorted({k for route in routes for k, _, _ in route})))
    heavy = staged(distinct.groupBy(key.alias("own")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
                   .select("own", F.explode(reach).alias("flip"))
                   .select(F.col("own").bitwiseXOR(F.col("flip")).alias("heavy")).distinct(), "heavy")
    way = F.when(F.bit_count("fp") % 2 == 0, F.expr(_literal(routes[0]))).otherwise(F.expr(_literal(routes[1])))
    routed = (distinct.repartition(parts, "fp").select("fp", F.explode(way).alias("way"))
              .select("fp", key.bitwiseXOR(F.col("way.col1")).alias("key"),
                      F.col("way.col2").alias("code"), F.col("way.col3").alias("n")))
    table = F.expr(_literal(flips))
    single = F.col("heavy").isNotNull()
    sent = routed.join(heavy, F.col("key") == F.col("heavy"), "left").select(
        "fp", "key", single.alias("single"),
        F.explode(F.when(single, F.sequence(F.col("code") + 1, F.col("code") + F.col("n")))
                  .otherwise(F.array("code"))).alias("code"))
    code = (F.col("code") + 1).cast("int")
    goal = F.when(F.col("single"), F.col("fp").bitwiseXOR(F.element_at(table, code)[0])).otherwise(F.col("key"))
    met = (sent.select("fp", "code", goal.alias("goal")).repartition(parts, "goal")
           .select("fp", F.explode(F.element_at(table, code)).alias("flip"))
           .select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp").sortWithinPartitions("variant"))
    return met.mapInArrow(_meet(radius), "u bigint, v bigint").distinct()


def groups(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for every distinct fingerprint: root is the group's smallest fingerprint."""
    found = staged(components(links(fps, radius)), "groups")
    alone = fps.select("fp").distinct()
    return alone.join(found, alone.fp == found.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (hex) and component_id, the smallest id it reaches."""
    fps = staged(fingerprints(docs), "fingerprints")
    own = groups(fps)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_root = own.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(own.join(by_root, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row per group: that with the smallest doc_id (nulls last, then by a hash).

    Only ids, fingerprints and row numbers are shuffled; the texts stay where they were read while the
    numbers of the rows to drop (``dropped``) go to them, by a broadcast up to ``BROADCAST_ROWS``.
    """
    rows = numbered(docs)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    gone = staged(dropped(rows.withColumnsRenamed({names["doc_id"]: "doc_id", names["text"]: "text"}), shingle, radius), "dropped")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, ["_file", "_row"], "left_anti").select(*[F.col(i).alias(c) for c, i in names.items()])


def dropped(rows: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(_file, _row) of all rows of ``rows`` but one per group."""
    found = map_columns(rows.select("doc_id", "text", "_file", "_row", row_key().alias("_key")),
                        ["doc_id", "_file", "_row", "_key"], [("fp", "bigint", pa.int64())], _hash(shingle))
    fps = staged(found, "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_key"), F.col("_file"), F.col("_row"))
    own = staged(groups(fps, radius), "roots")
    best = (own.join(fps.groupBy("fp").agg(F.min(order).alias("best")), "fp").groupBy("root")
            .agg(F.min("best").alias("best")).select("root", "best._file", "best._row"))
    kept = staged(own.join(best.withColumnsRenamed({"_file": "_kept_file", "_row": "_kept_row"}), "root")
                  .select("fp", "_kept_file", "_kept_row"), "kept")
    return fps.join(kept, "fp").where((F.col("_file") != F.col("_kept_file")) | (F.col("_row") != F.col("_kept_row"))).select(
        "_file", "_row")
