"""Audit of how far the sources of a language diverge in their words, with late strings.

Counting works on 64-bit term digests: a pass over the texts emits (lang, source, digest, count,
documents), aggregated before and after one shuffle, in which no term travels. Terms kept by
their document count then get their text in a second pass, which returns the smallest and the
largest string of every digest: where the two differ, terms collided, and a third pass counts just
these by their strings (``alt`` holds the string, empty otherwise). A digest below the document
limit needs no look: each of its terms is below it too. Strings are joined back only to the rows
of the report.

All arithmetic is exact: probabilities are integers (parts of 1,000,000,000, computed as
decimals), values floor((p - q)^2 / (p + q)).

Source pairs are compared over dense rows, one per kept term and language with the
probability in every source; tasks add up a matrix of sources by sources, written out whenever
it outgrows ``MATRIX`` numbers, so hot terms, sources or languages do not gather anywhere. The
ranks of terms need two steps: the lowest value among the best ``top`` (without strings), then
the strings of all rows that reach it; both windows drop rows before their shuffle.

Defined cases: null text, lang and source are empty strings; a group without terms has count 0
everywhere; without kept terms pairs have value 0 and there are no term rows; equal values are
ordered by the item's UTF-8 bytes; repeated rows count each, as do rows with null ids; very long
texts are worked whole, a few dozen times their size in a task; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import staged
from .textops import LOWER, Chunk, chunks, span_hash

MIN_DOCS = 10
TOP = 10
PARTS = 1_000_000_000
CHUNK = 1 << 20
#: counts, or strings, that a task gathers before it passes them on
HELD = 1 << 20
#: groups and languages are broadcast up to so many rows, and left to the planner beyond
BROADCAST_ROWS = 100_000
#: numbers a task holds of all its matrices of source pairs
MATRIX = 1 << 24
_BLOCK = 1 << 21
#: bytes of words ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after A-Z are lower-cased
LETTERS = np.array([0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])

Grouped = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _words(chunk: Chunk, mask: int):
    """Lower-cased bytes, word starts and ends, document bounds and digests of a chunk."""
    data = LOWER[chunk.data]
    start, end, bound = chunk.words(LETTERS, data)
    digest = span_hash(data, start, end) & np.uint64(mask)
    return data, start, end, bound, digest


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (the first matters most), and where each run of equal keys starts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _per_group(group: np.ndarray, doc: np.ndarray, digest: np.ndarray) -> Grouped:
    """(group, digest, occurrences, documents) from one row per word."""
    order, first = _runs(doc, digest)
    n = np.diff(np.append(first, len(order)))
    doc, digest = doc[order][first], digest[order][first]
    order, first = _runs(group[doc], digest)
    total = np.add.reduceat(n[order], first) if len(first) else n[:0]
    docs = np.diff(np.append(first, len(order)))
    at = order[first]
    return group[doc[at]], digest[at], total, docs


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, Callable[[np.ndarray], list[pa.Array]]]:
    """Number of each row's (lang, source), and the two names of such numbers."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    size = max(1, len(source.dictionary))
    number = lang.indices.to_numpy().astype(np.int64) * size + source.indices.to_numpy()

    def names(group: np.ndarray) -> list[pa.Array]:
        return [lang.dictionary.take(pa.array(group // size)), source.dictionary.take(pa.array(group % size))]
    return number, names


def _added(parts: list[Grouped]) -> Grouped:
    """Counts of several chunks as one."""
    group, digest, n, docs = (np.concatenate(x) for x in zip(*parts))
    order, first = _runs(group, digest)
    if not len(first):
        return group, digest, n, docs
    at = order[first]
    return group[at], digest[at], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


def _count(mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, names = _groups(batch)

            def rows(counted: Grouped, names=names) -> pa.RecordBatch:
                group, digest, n, docs = counted
                return pa.RecordBatch.from_arrays(
                    [*names(group), pa.array(digest.view(np.int64)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                    ["lang", "source", "digest", "n", "docs"])
            held: list[Grouped] = []
            for chunk in chunks(batch.column("text"), CHUNK):
                *_, bound, digest = _words(chunk, mask)
                doc = np.repeat(np.arange(chunk.first, chunk.first + chunk.n), np.diff(bound))
                held.append(_per_group(number, doc, digest))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(held.pop())
            if held:
                yield rows(_added(held))
    return run


def _each(size: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for every size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


class _Spellings:
    """One string per digest in a byte pool, and the two ends for digests that have several."""

    def __init__(self):
        self.digest, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)      # sorted by digest
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)         # by entry
        self.pool, self.filled = np.empty(1 << 20, np.uint8), 0
        self.ends: dict[int, tuple[bytes, bytes]] = {}                               # by entry

    def _take_in(self, digest: np.ndarray, text: np.ndarray, size: np.ndarray) -> None:
        while self.filled + len(text) > len(self.pool):
            self.pool = np.append(self.pool, np.empty(len(self.pool), np.uint8))
        self.pool[self.filled:self.filled + len(text)] = text
        every = np.append(self.digest, digest)
        order = np.argsort(every, kind="stable")
        self.digest = every[order]
        self.entry = np.append(self.entry, len(self.size) + np.arange(len(digest)))[order]
        self.start = np.append(self.start, self.filled + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.filled += len(text)

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, digest: np.ndarray) -> None:
        """Compare every word with the string of its digest, byte by byte."""
        unique, first, back = np.unique(digest, return_index=True, return_inverse=True)
        size = end - start
        at = np.searchsorted(self.digest, unique)
        new = at == len(self.digest)
        new[~new] = self.digest[at[~new]] != unique[~new]
        if new.any():
            own = first[new]
            self._take_in(unique[new], data[np.repeat(start[own], size[own]) + _each(size[own])], size[own])
        model = self.entry[np.searchsorted(self.digest, unique)][back]
        other = size != self.size[model]
        step = _each(size)
        like = np.minimum(np.repeat(self.start[model], size) + step, self.filled - 1)
        differs = data[np.repeat(start, size) + step] != self.pool[like]
        other[np.repeat(np.arange(len(size)), size)[differs]] = True
        for w in np.flatnonzero(other).tolist():
            e, word = int(model[w]), data[start[w]:end[w]].tobytes()
            low, high = self.ends.get(e) or (self.pool[self.start[e]:self.start[e] + self.size[e]].tobytes(),) * 2
            self.ends[e] = min(low, word), max(high, word)

    def rows(self) -> pa.RecordBatch:
        digest = np.empty(len(self.size), np.uint64)
        digest[self.entry] = self.digest
        offsets = np.append(self.start, self.filled).astype(np.int32)
        least = pa.StringArray.from_buffers(len(digest), pa.py_buffer(offsets), pa.py_buffer(self.pool[:self.filled].tobytes()))
        most = least
        if self.ends:
            low, high = least.to_pylist(), least.to_pylist()
            for e, (a, b) in self.ends.items():
                low[e], high[e] = a.decode(), b.decode()
            least, most = pa.array(low, pa.string()), pa.array(high, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), least, most], ["digest", "least", "most"])


def _spelled(mask: int):
    """mapInArrow body: smallest and largest string of the digests of a task, in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Spellings()
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK):
                data, start, end, _, digest = _words(chunk, mask)
                if len(digest):
                    held.add(data, start, end, digest)
                if len(held.size) > HELD // 4:
                    yield held.rows()
                    held = _Spellings()
        if len(held.size):
            yield held.rows()
    return run


def _count_strings(mask: int):
    """mapInArrow body: counts by digest and string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, names = _groups(batch)
            for chunk in chunks(batch.column("text"), CHUNK):
                data, start, end, bound, digest = _words(chunk, mask)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
                code = {w: i for i, w in enumerate(dict.fromkeys(words))}
                own = np.fromiter((code[w] for w in words), np.int64, len(words))
                digests = np.zeros(len(code), np.uint64)
                digests[own] = digest
                doc = np.repeat(np.arange(chunk.first, chunk.first + chunk.n), np.diff(bound))
                group, own, n, docs = _per_group(number, doc, own)
                yield pa.RecordBatch.from_arrays(
                    [*names(group), pa.array(digests[own].view(np.int64)),
                     pa.array(list(code), pa.binary()).cast(pa.string()).take(pa.array(own)),
                     pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                    ["lang", "source", "digest", "alt", "n", "docs"])
    return run


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * terms)) as a bigint; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", wide(count + 2) * F.lit(PARTS), wide(total + terms * 2))
    return F.when(terms > 0, share + 1)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for the small side of a join, of known size."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, digest_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (lang, source, digest, alt, n), kept terms (lang, digest, alt, total) and names (digest, alt, term).

    ``docs`` has the columns lang, source, text without nulls. Fewer ``digest_bits`` give the
    same terms by way of more collisions.
    """
    mask = (1 << digest_bits) - 1
    key = ["lang", "digest", "alt"]
    sums = (F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = staged(docs.mapInArrow(_count(mask), "lang string, source string, digest bigint, n bigint, docs bigint")
                    .groupBy("lang", "source", "digest").agg(*sums).withColumn("alt", F.lit("")), "term-counts")

    def kept_of(df: DataFrame) -> DataFrame:
        return staged(df.groupBy(*key).agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
                      .where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    kept = kept_of(counts)
    spelled = docs.select("text").mapInArrow(_spelled(mask), "digest bigint, least string, most string")
    names = staged(spelled.join(kept.select("digest").distinct(), "digest", "left_semi")
                   .groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most")), "term-names")
    collided = names.where("least < most").select("digest")
    names = names.select("digest", F.lit("").alias("alt"), F.col("least").alias("term"))
    if collided.isEmpty():
        return counts, kept, names
    exact = staged(docs.mapInArrow(_count_strings(mask), "lang string, source string, digest bigint, alt string, n bigint, docs bigint")
                   .join(collided, "digest", "left_semi").groupBy("lang", "source", "digest", "alt").agg(*sums),
                   "collided-terms")
    counts = staged(counts.join(collided, "digest", "left_anti").unionByName(exact), "split-counts")
    names = names.join(collided, "digest", "left_anti").unionByName(
        exact.select("digest", "alt", F.col("alt").alias("term")).distinct())
    return counts, kept_of(counts), names


def _pair_sums():
    """mapInArrow body over (lang, at, p, base): sums over terms of the value of every two sources."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def written() -> Iterator[pa.RecordBatch]:
            for lang, sums in held.items():
                n = len(sums)
                for a in range(n - 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([a], pa.int32()), pa.array([sums[a, a + 1:].tolist()], pa.list_(pa.int64()))],
                        ["lang", "a", "sums"])
            held.clear()

        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            number = lang.indices.to_numpy()
            at, p, base = (batch.column(c) for c in ("at", "p", "base"))
            for i, name in enumerate(lang.dictionary.to_pylist()):
                rows = np.flatnonzero(number == i)
                sources = int(base.value_lengths()[int(rows[0])].as_py())
                if name not in held:
                    if sum(x.size for x in held.values()) + sources * sources > MATRIX:
                        yield from written()
                    held[name] = np.zeros((sources, sources), np.int64)
                sums = held[name]
                for part in np.array_split(rows, max(1, len(rows) * sources // _BLOCK)):
                    take = pa.array(part)
                    dense = base.take(take).flatten().to_numpy().reshape(len(part), sources).copy()
                    own = at.take(take)
                    row = np.repeat(np.arange(len(part)), own.value_lengths().to_numpy())
                    dense[row, own.flatten().to_numpy()] = p.take(take).flatten().to_numpy()
                    for a in range(sources - 1):
                        x, y = dense[:, a:a + 1], dense[:, a + 1:]
                        gap = x - y
                        sums[a, a + 1:] += (gap * gap // (x + y)).sum(axis=0)
        yield from written()
    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every (lang, source) group."""
    docs = _documents(docs)
    counts, kept, names = term_counts(docs, min_docs, digest_bits)
    key = ["lang", "digest", "alt"]
    sums = counts.join(kept, key, "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("size"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    # one row per (lang, source); places of sources within a language start at 0
    groups = staged(docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
                    .join(whole, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
                    .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
                    .withColumn("base", _p(F.lit(0).cast("bigint"), F.col("size"), F.col("terms"))), "groups")
    n_groups = groups.count()
    langs = staged(groups.groupBy("lang").agg(
        F.max("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("place", "source", "base"))).alias("own"))
        .select("lang", "terms", "own.source", "own.base"), "langs")
    rows = (counts.join(kept, key).join(_small(groups.drop("base"), n_groups), ["lang", "source"])
            .withColumn("p", _p(F.col("n"), F.col("size"), F.col("terms"))))

    dense = (rows.groupBy(*key).agg(F.collect_list("place").alias("at"), F.collect_list("p").alias("p"))
             .join(_small(langs.select("lang", "base"), n_groups), "lang").select("lang", "at", "p", "base"))
    found = (dense.mapInArrow(_pair_sums(), "lang string, a int, sums array<bigint>")
             .select("lang", "a", F.posexplode("sums").alias("b", "value"))
             .groupBy("lang", "a", (F.col("a") + F.col("b") + 1).alias("b")).agg(F.sum("value").alias("value")))
    without = (langs.where("terms = 0").select("lang", "source", F.posexplode("source").alias("a", "_a"))
               .select("lang", "a", F.posexplode("source").alias("b", "_b")).where("a < b")
               .select("lang", "a", "b", F.lit(0).cast("bigint").alias("value")))
    both = staged(found.select("lang", "a", "b", "value").unionByName(without), "pairs")
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pair = both.join(_small(langs.select("lang", F.col("source").alias("sources")), n_groups), "lang").select(
        "lang", F.element_at("sources", F.col("a") + 1).alias("source"), F.lit("pair").alias("part"),
        F.element_at("sources", F.col("b") + 1).alias("item"), "value")

    q = _p(F.col("total"), F.col("lang_size"), F.col("terms"))
    gap = F.col("p") - F.col("q")
    high = rows.withColumn("q", q).where("p > q").select(
        "lang", "source", "digest", "alt", F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    own = Window.partitionBy("lang", "source")
    high = staged(high, "high-terms")
    least = (high.withColumn("r", F.row_number().over(own.orderBy(F.desc("value")))).where(F.col("r") <= top)
             .groupBy("lang", "source").agg(F.min("value").alias("least")))
    term = (high.join(_small(least, n_groups), ["lang", "source"]).where("value >= least").join(names, ["digest", "alt"])
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    order = own.orderBy(F.desc("value"), "item")
    return (pair.withColumn("rank", F.row_number().over(order)).unionByName(
        term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))
