"""Line dedup by distinct-site spread.

A line that is not blank (without outer spaces, lower-cased) and occurs at ``MIN_SITES`` sites or
more is boilerplate; a caller may ask for at least ``min_words`` - 1 inner spaces. Sites are counted by a HyperLogLog sketch per line hash, merged by
partial aggregation before the shuffle. Estimates clearly under or over the threshold decide;
lines within ``BAND`` of it get exact distinct counts. Boilerplate lines leave every document
but the one with the smallest doc_id that has them, so no line is lost to the corpus. A table of
boilerplate lines within ``BROADCAST_LINES`` goes to the texts by broadcast; beyond it the numbers of
the lines to remove go to them by a join on id and row key. Removal is linear in a text's lines.

Defined cases: a null text has no lines and stays null; an empty text has one empty line; null sites
count as one site; with null ids only, no document is the first, and the line leaves all of
them; rows of equal doc_id are first together; an empty table gives no rows; further columns may have
any names; a text is worked whole, however long. Lines keep their
order, and untouched texts stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_columns, row_key, staged

MIN_SITES = 10
MIN_WORDS = 1
LG_K = 12
#: boilerplate lines (17 bytes each) that are broadcast at most
BROADCAST_LINES = 1 << 19
#: estimates within this share of the threshold are counted exactly (a sketch of 2 ** LG_K
#: registers errs by under 2 % in one of two cases, and by under 8 % in all but one of 10 ** 6)
BAND = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def line_rows(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """Staged candidate lines: _key, doc_id, site, i (line number), line (hash of the normal form)."""
    rows = docs.select("doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
                       row_key().alias("_key"), F.posexplode(_lines(F.col("text"))).alias("i", "line"))
    normal = _normal(F.col("line"))
    spaces = F.length(normal) - F.length(F.translate(normal, " ", ""))
    return staged(rows.where(spaces >= min_words - 1 if min_words > 1 else normal.rlike(r"\S"))
                  .select("doc_id", "site", "_key", "i", F.xxhash64(normal).alias("line")), "lines")


def boilerplate(rows: DataFrame, min_sites: int) -> DataFrame:
    """(line, first_doc): lines of ``min_sites`` or more distinct sites and their first document."""
    # most lines stay at one site; a sketch is made for the others only
    several = staged(rows.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b"))
                     .where((F.col("a") != F.col("b")) | (min_sites < 2)).select("line"), "several-sites")
    spread = staged(rows.join(several, "line").groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"), F.min("doc_id").alias("first_doc"))
        .where(F.col("about") >= min_sites * (1 - BAND)), "spread")
    near = spread.where(F.col("about") <= min_sites * (1 + BAND)).select("line", "first_doc")
    exact = (rows.select("line", "site").join(near, "line").groupBy("line", "first_doc", "site").agg(F.lit(1).alias("x"))
             .groupBy("line", "first_doc").agg(F.count("x").alias("n")).where(F.col("n") >= min_sites))
    far = spread.where(F.col("about") > min_sites * (1 + BAND)).select("line", "first_doc")
    return staged(far.unionByName(exact.select("line", "first_doc")), "boilerplate")


def _numbers(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """(_key, _id, _gone): line numbers to remove, one row per touched document key."""
    hit = rows.select("line", "doc_id", "_key", "i").join(bad, "line").where(
        ~F.col("doc_id").eqNullSafe(F.col("first_doc")) | F.col("first_doc").isNull())
    return hit.groupBy("_key", F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("i")).alias("_gone"))


def _in_table(model):
    """For a batch with line hashes (_hashes) and hashed ids (_own): numbers of the lines to remove, per row."""
    def find(batch: pa.RecordBatch) -> list[np.ndarray]:
        known, first, always = model.value
        hashes = batch.column("_hashes")
        size = hashes.value_lengths().fill_null(0).to_numpy()
        line = hashes.flatten().to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(known, line), len(known) - 1)
        own = batch.column("_own").to_numpy()[owner]
        hit = np.flatnonzero((known[at] == line) & (always[at] | (first[at] != own)))
        bound = np.append(0, np.cumsum(size))
        cut = np.searchsorted(hit, bound)
        return [hit[a:b] - start for a, b, start in zip(cut[:-1], cut[1:], bound)]
    return find


def _listed(batch: pa.RecordBatch) -> list:
    return [x or () for x in batch.column("_gone").to_pylist()]


def _cutter(find):
    """Task body: each text without the lines that ``find`` numbers (null if it has none of them), lines, lines removed."""
    def compute(batch: pa.RecordBatch):
        kept, total, removed = [], [], []
        for text, gone in zip(batch.column("_text"), find(batch)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else None
            total.append(0 if raw is None else raw.count(b"\n") + 1)
            removed.append(len(gone))
            if not len(gone):
                kept.append(None)
                continue
            lines = raw.split(b"\n")
            for i in gone:
                lines[i] = None
            kept.append(b"\n".join([x for x in lines if x is not None]))
        return [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
    return lambda: compute


_ADDED = [("_kept", "string", pa.string()), ("_n_lines", "bigint", pa.int64()), ("_n_removed", "bigint", pa.int64())]


def _with_removals(docs: DataFrame, columns: list[str], site: str = "source", min_sites: int = MIN_SITES,
                   min_words: int = MIN_WORDS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Columns _c0, _c1, ... with _kept (the text left; null if no line goes), _n_lines and _n_removed.

    Up to ``broadcast_lines`` boilerplate lines go to the texts, which stay where they are. Beyond it the
    numbers of the lines to remove meet their texts in a join.
    """
    rows = line_rows(docs, site, min_words)
    bad = boilerplate(rows, min_sites)
    keep = [f"_c{i}" for i in range(len(columns))]
    texts = [*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, keep)], F.col("text").alias("_text")]
    if 0 < bad.count() <= broadcast_lines:
        known = bad.select("line", F.xxhash64("first_doc").alias("first"), F.col("first_doc").isNull().alias("always")).toArrow()
        known = known.sort_by("line")
        model = docs.sparkSession.sparkContext.broadcast(
            tuple(known.column(c).to_numpy() for c in ("line", "first", "always")))
        hashes = F.transform(_lines(F.col("text")), lambda line: F.xxhash64(_normal(line)))
        return map_columns(docs.select(*texts, F.xxhash64("doc_id").alias("_own"), hashes.alias("_hashes")), keep, _ADDED,
                           _cutter(_in_table(model)))
    gone = staged(_numbers(rows, bad), "removals")
    own = docs.select(*texts, F.col("doc_id").alias("_doc"), row_key().alias("_own"))
    # the row key covers the whole text, so a removal list always fits its text
    joined = own.join(gone, (F.col("_own") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
    return map_columns(joined.select(*keep, "_text", "_gone"), keep, _ADDED, _cutter(_listed))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the lines kept, joined again)."""
    out = _with_removals(docs, ["doc_id", "text"], **options)
    return out.select(F.col("_c0").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                      F.sha2(F.coalesce("_kept", "_c1", F.lit("")), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with boilerplate lines removed from their texts (n_chars follows)."""
    touched = F.col("_n_removed") > 0
    new = {"text": F.col("_kept"), "n_chars": F.char_length("_kept")}
    return _with_removals(docs, docs.columns, **options).select(
        *[F.when(touched, new[c]).otherwise(F.col(f"_c{i}")).alias(c) if c in new else F.col(f"_c{i}").alias(c)
          for i, c in enumerate(docs.columns)])
