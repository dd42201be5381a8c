"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (lower-cased A-Z, see ``ALNUM``) are built into suffix automata, one per
*block* of at most about ``block_words`` words, each by a Spark task. Training documents are
streamed through every automaton word by word; the state and the length of the longest
suffix that occurs in an item follow at each word. Words under matches of ``window`` words or
more, or under whole items that are shorter, are hit.

Size: an automaton has at most two states per word of its block, so what is broadcast is
bounded by ``block_words``; a larger benchmark gives more blocks, ``blocks_per_pass`` of them
at a time over the documents. Documents are not shuffled.

Defined cases: null or wordless texts (documents or items) have no words and no hits; an item
with a null id marks words but is neither listed nor counted; repeated items count once by
id; repeated document rows give repeated result rows; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_columns, staged
from .textops import ALNUM, LOWER, Chunk, chunks, span_hash, worker_state

WINDOW = 10
PIECE_WORDS = 4096
BLOCK_WORDS = 200_000
BLOCKS_PER_PASS = 4


class Automaton:
    """Suffix automaton over many word sequences (words are 64-bit hashes)."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: items of the windows that a state stands for, and short items by state: (length, item)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.marked: list[int] = []

    def extend(self, last: int, word: int) -> int:
        """Append ``word`` after the prefix of state ``last``; returns the new last state."""
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p == -1:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the shorter strings of ``q`` that end in p's strings and ``word``."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self.extend(last, word)

    def label(self, item: str | None, words: list[int]) -> None:
        """Note the item at the states of its windows; call after all items are added."""
        state = 0
        if 0 < len(words) < self.window:
            for word in words:
                state = self.next[state][word]
            self.short.setdefault(state, []).append((len(words), item))
            return
        for i, word in enumerate(words):
            state = self.next[state][word]
            if i + 1 >= self.window and item is not None:
                self.items.setdefault(self.trimmed(state), set()).add(item)

    def trimmed(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def finish(self) -> None:
        """Nearest state with short items on each suffix path, by ascending length."""
        self.marked = [-1] * len(self.link)
        if self.short:
            for v in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.marked[v] = v if v in self.short else self.marked[self.link[v]] if v else -1

    def scan(self, words: list[int], found: set[str]) -> Iterator[tuple[int, int, int]]:
        """(start, end, longest match length) of matches in a run of words; items go to ``found``."""
        state = size = 0
        length, link, edges, window = self.length, self.link, self.next, self.window
        for i, word in enumerate(words):
            while state and word not in edges[state]:
                state = link[state]
                size = length[state]
            if word in edges[state]:
                state = edges[state][word]
                size += 1
            if size >= window:
                found.update(self.items.get(self.trimmed(state), ()))
                yield i + 1 - size, i + 1, size
            if self.short and self.marked[state] >= 0:
                v = self.marked[state]
                while v > 0:
                    for n, item in self.short[v]:
                        if n <= size:
                            if item is not None:
                                found.add(item)
                            yield i + 1 - n, i + 1, size
                    v = self.marked[link[v]] if link[v] >= 0 else -1


def words_of(chunk: Chunk):
    """Word hashes, starts, ends and document bounds of a chunk."""
    low = LOWER[chunk.data]
    start, end, bound = chunk.words(ALNUM, low)
    return span_hash(low, start, end), start, end, bound


def _pieces(window: int, piece_words: int):
    """mapInArrow body: each item's word hashes, long items in pieces that share window - 1 words."""
    def run(batches):
        for batch in batches:
            ids, pieces = [], []
            names = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                words, _, _, bound = words_of(chunk)
                for i in range(chunk.n):
                    own = words[bound[i]:bound[i + 1]]
                    for at in range(0, max(1, len(own) - window + 1), piece_words):
                        part = own[at:at + piece_words + window - 1]
                        if len(part):
                            ids.append(names[chunk.first + i])
                            pieces.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.binary())],
                                             ["item", "words"])
    return run


def _build(window: int):
    """applyInPandas body: the automaton of one block of items."""
    def run(pdf):
        import pandas as pd
        built = Automaton(window)
        rows = sorted(zip(pdf["item"], pdf["words"]), key=lambda r: (r[1], r[0] or ""))
        pieces = [(item, np.frombuffer(raw, np.uint64).tolist()) for item, raw in rows]
        for _, words in pieces:
            built.add(words)
        for item, words in pieces:
            built.label(item, words)
        built.finish()
        return pd.DataFrame({"block": pdf["block"].head(1), "model": [pickle.dumps(built.__dict__, 5)]})
    return run


def build_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
                 piece_words: int = PIECE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row (block, model) per block of benchmark items, built by one task each."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    # repeated pieces add nothing to an automaton, and all of them would go to one block
    pieces = staged(items.mapInArrow(_pieces(window, piece_words), "item string, words binary").distinct(), "items")
    total = pieces.agg(F.sum(F.length("words")).alias("n")).first()["n"] or 0
    n_blocks = -(-total // 8 // block_words) or 1
    block = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)).cast("int")
    return staged(pieces.withColumn("block", block).groupBy("block")
                  .applyInPandas(_build(window), "block int, model binary"), "automata")


def _scanner(models: list, clean: tuple[int, float, int] | None, n_before: int):
    """Task body: stream each document through the automata of this pass."""
    def make():
        state = worker_state("automata")
        built = []
        for key, broadcast in models:
            if key not in state:
                while len(state) >= 2 * BLOCKS_PER_PASS:
                    state.pop(next(iter(state)))
                one = Automaton.__new__(Automaton)
                one.__dict__.update(pickle.loads(broadcast.value))
                vocab = np.array(sorted({w for edges in one.next[:1] for w in edges}), dtype=np.uint64)
                least = min([one.window, *(n for marks in one.short.values() for n, _ in marks)])
                state[key] = one, vocab, least
            built.append(state[key])

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            before_spans = batch.column("_spans").to_pylist() if n_before else None
            before_items = batch.column("_items").to_pylist() if n_before else None
            before_long = batch.column("_longest").to_pylist() if n_before else None
            n_words, spans, items, longest, texts = [], [], [], [], []
            for chunk in chunks(batch.column("_text")):
                words, start, end, bound = words_of(chunk)
                for i in range(chunk.n):
                    row = chunk.first + i
                    n_words.append(int(bound[i + 1] - bound[i]))
                    spans.append(list(before_spans[row]) if n_before else [])
                    items.append(set(before_items[row]) if n_before else set())
                    longest.append(before_long[row] if n_before else 0)
                owner = np.repeat(np.arange(chunk.n), np.diff(bound))
                for automaton, vocab, least in built:
                    if not len(vocab) or not len(words):
                        continue
                    at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
                    known = vocab[at] == words
                    fresh = np.append(True, owner[1:] != owner[:-1])
                    first = np.flatnonzero(known & (np.append(True, ~known[:-1]) | fresh))
                    last = np.flatnonzero(known & (np.append(~known[1:], True) | np.append(fresh[1:], True))) + 1
                    for a, b in zip(first.tolist(), last.tolist()):
                        if b - a >= least:
                            row = chunk.first + int(owner[a])
                            shift = a - int(bound[owner[a]])
                            got = list(automaton.scan(words[a:b].tolist(), items[row]))
                            if got:
                                longest[row] = max(longest[row], max(g[2] for g in got))
                                spans[row] = merged(spans[row] + [(s + shift, e + shift) for s, e, _ in got])
                if clean:
                    for i in range(chunk.n):
                        row = chunk.first + i
                        texts.append(cut(chunk, i, start[bound[i]:bound[i + 1]], end[bound[i]:bound[i + 1]],
                                         spans[row], *clean))
            out = [pa.array(n_words, pa.int64()), pa.array([[list(s) for s in x] for x in spans],
                                                           pa.list_(pa.list_(pa.int32()))),
                   pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest, pa.int32())]
            return out + [pa.array(texts, pa.string())] if clean else out
        return compute
    return make


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted, non-overlapping union of half-open spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(chunk: Chunk, i: int, start, end, spans, max_words: int, max_coverage: float, window: int = WINDOW) -> str | None:
    """Document ``i`` without its hit spans of ``max_words`` words or more, and those of under ``window``
    words, which only whole short items give; null if more than ``max_coverage`` of its words are hit."""
    raw = chunk.data[chunk.starts[i]:chunk.ends[i]].tobytes()
    if spans and sum(e - s for s, e in spans) > max_coverage * len(start):
        return None
    at, kept = 0, []
    for s, e in spans:
        if e - s >= max_words or e - s < window:
            a, b = int(start[s] - chunk.starts[i]), int(end[e - 1] - chunk.starts[i])
            kept.append(raw[at:a])
            at = b
    kept.append(raw[at:])
    return b"".join(kept).decode()


def _scan(docs: DataFrame, benchmark: DataFrame, columns: list[str], text_col: str = "text", window: int = WINDOW,
          block_words: int = BLOCK_WORDS, clean: tuple[int, float] | None = None) -> DataFrame:
    """``columns`` of ``docs`` as _c0, _c1, ... with ``_n_words``, ``_spans`` (hit word ranges),
    ``_items`` (item ids with an occurring window) and ``_longest`` (longest match in words);
    with ``clean`` = (span length limit, coverage limit) also ``_clean``, the text without the
    spans of that length or more and whole items under ``window`` words, null beyond that coverage."""
    keep = [f"_c{i}" for i in range(len(columns))]
    spark = docs.sparkSession
    blocks = build_blocks(benchmark, window=window, block_words=block_words)
    ids = sorted(r["block"] for r in blocks.select("block").collect())
    out = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, keep)], F.col(text_col).alias("_text"))
    found = [("_n_words", "bigint", pa.int64()), ("_spans", "array<array<int>>", pa.list_(pa.list_(pa.int32()))),
             ("_items", "array<string>", pa.list_(pa.string())), ("_longest", "int", pa.int32())]
    passes = [ids[i:i + BLOCKS_PER_PASS] for i in range(0, len(ids), BLOCKS_PER_PASS)] or [[]]
    for n, own in enumerate(passes):
        models = []
        for block in own:
            value = blocks.where(F.col("block") == block).first()["model"]
            models.append((hashlib.md5(value).hexdigest(), spark.sparkContext.broadcast(bytes(value))))
        last = n == len(passes) - 1
        carried = keep + ([] if last else ["_text"])
        text = [("_clean", "string", pa.string())] if last and clean else []
        out = map_columns(out, carried, found + text, _scanner(models, (*clean, window) if last and clean else None, n))
        if not last:
            out = staged(out, "decontaminate")
    return out


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, text_col: str = "text",
         window: int = WINDOW, block_words: int = BLOCK_WORDS, clean: tuple[int, float] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and what ``_scan`` adds; columns of these names are replaced."""
    columns = columns if columns is not None else docs.columns
    out = _scan(docs, benchmark, columns, text_col, window, block_words, clean)
    added = out.columns[len(columns):]
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in added], *added)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("_spans", F.lit(0), lambda n, s: n + s[1] - s[0]).cast("bigint")
    return scan(docs, benchmark, ["doc_id"]).select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_words: int = WINDOW,
                   max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with benchmark spans of ``max_words`` words or more and whole shorter items cut from the
    text (all hits at the default; above it, short items that touch other hits count as one span with them); documents
    with more than ``max_coverage`` of their words hit go. Untouched texts stay byte for byte."""
    found = _scan(docs, benchmark, docs.columns, clean=(max_words, max_coverage))
    touched = F.size("_spans") > 0
    gone = touched & F.col("_clean").isNull()
    new = {"text": F.col("_clean"), "n_chars": F.char_length("_clean")}
    return found.where(~gone).select(*[
        F.when(touched, new[c]).otherwise(F.col(f"_c{i}")).alias(c) if c in new else F.col(f"_c{i}").alias(c)
        for i, c in enumerate(docs.columns)])
