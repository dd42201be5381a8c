"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised as the model does (here: spaces become U+2581, one is put before the
text) and cut where no vocabulary piece reaches across: before a run of spaces and round
characters that no longer piece contains. The parts then encode independently, and so do the
stretches of a part between neighbours that stand side by side in no piece. In a stretch, an
agenda (a heap) holds the adjacent symbol pairs whose join is a piece, best score first,
leftmost first among equals; the best pair is joined and its new neighbours are added until the
agenda is empty. Symbols that are no piece become their UTF-8 bytes. Decoding joins the pieces
of the ids again.

Every part that a worker has not met before is encoded and decoded by the sentencepiece library
too, batch by batch; where the two differ, the library's result stands and the row counts it
(``n_corrected``, 0 in all tests). Parts of up to ``CACHE_CHARS`` characters are kept in a worker-wide table of
at most ``CACHE_PARTS`` (then it starts anew).

Defined cases: null texts count as empty and give the end id alone; repeated rows and ties need
nothing (rows do not meet); a very long text is held whole in its task, an agenda only per stretch; an
empty table gives no rows; other columns of the input are not read. A vocabulary whose
normaliser changes more than spaces, or that is not of merge type, is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_columns
from .textops import worker_state
from .tokens import tokenizer_path

SPACE = "▁"
CACHE_PARTS = 1_200_000
CACHE_CHARS = 64


class PieceModel:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        probe = " a  Åﬁ　 x "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path}: the normaliser changes more than spaces")
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: unused pieces are not supported")
        self.piece = {self.text[i]: i for i in range(n) if not special[i]}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(self.text[i][3:5], 16)]) if sp.is_byte(i)
                    else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.end = sp.eos_id()
        self.decimal = [b"%d " % i for i in range(n)]
        if len(self.byte) != 256:
            raise ValueError(f"{path}: byte fallback is needed")
        longer = [p for p in self.piece if len(p) > 1]
        self.pairs = {p[i:i + 2] for p in longer for i in range(len(p) - 1)}
        inside = {c for p in longer for c in p}
        lone = "".join(chr(c) for c in range(0x80) if chr(c) not in inside and chr(c) != " ")
        if not all(SPACE not in p.lstrip(SPACE) for p in longer):
            raise ValueError(f"{path}: pieces that span words are not supported")
        lone = "".join(map(re.escape, lone))
        # parts: spaces and what follows up to the next space or lone character, or a lone character
        self.cut = re.compile(rf"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+|[{lone}]" if lone
                              else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        # a character that is in no longer piece, put before a part to keep the library's own space apart
        self.guard = next((chr(c) for c in range(0x80) if chr(c) not in inside and chr(c) != " "), None)
        self.parts: dict[str, bytes] = {}               # ids in decimal, each followed by a space
        self.stretches: dict[str, bytes] = {}
        self.odd: dict[str, tuple[bytes, int]] = {}     # parts that decode to another text or were corrected
        # symbols: pieces by id, then single characters that only longer pieces hold, then one for all others
        self.symbol = {c: n + i for i, c in enumerate(sorted(inside - self.piece.keys()))} | self.piece
        self.other = self.width = n + len(inside) + 1
        order = {x: i for i, x in enumerate(sorted({-sp.get_score(self.piece[p]) for p in longer}))}
        self.join: dict[int, int] = {}         # pair of symbols -> piece
        self.rank: dict[int, int] = {}         # pair of symbols -> place of its score, in the upper bits
        for p in longer:
            place = order[-sp.get_score(self.piece[p])] << 32
            for i in range(1, len(p)):
                left, right = self.symbol.get(p[:i]), self.symbol.get(p[i:])
                if left is not None and right is not None:
                    self.join[left * self.width + right] = self.piece[p]
                    self.rank[left * self.width + right] = place

    def agenda(self, part: str) -> list[int]:
        """Ids of one part. Entries of the heap are place of the score << 32 | left symbol."""
        symbol, other, width, rank, join = self.symbol, self.other, self.width, self.rank, self.join
        ids = [symbol.get(c, other) for c in part]
        n = len(ids)
        heap = [place | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (place := rank.get(a * width + b)) is not None]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(heap)
        while heap:
            best = heapq.heappop(heap)
            i = best & 0xFFFFFFFF
            k = after[i]
            if ids[i] < 0 or k == n:
                continue
            key = ids[i] * width + ids[k]
            if rank.get(key) != best - i:          # one of the two was joined with another symbol meanwhile
                continue
            ids[i] = own = join[key]
            ids[k] = -1
            after[i] = k = after[k]
            if k < n:
                before[k] = i
                place = rank.get(own * width + ids[k])
                if place is not None:
                    heapq.heappush(heap, place | i)
            k = before[i]
            if k >= 0:
                place = rank.get(ids[k] * width + own)
                if place is not None:
                    heapq.heappush(heap, place | k)
        if max(ids, default=0) < len(self.text):
            return [i for i in ids if i >= 0]
        out: list[int] = []
        for i, c in zip(ids, part):                # symbols that are no piece are single characters
            if i >= 0:
                out += [i] if i < len(self.text) else [self.byte[b] for b in c.encode()]
        return out

    def split(self, part: str) -> list[str]:
        """``part`` cut between neighbours that stand side by side in no piece.

        A word loses the mark after it; only long parts are searched throughout.
        """
        pairs = self.pairs
        if len(part) <= CACHE_CHARS:
            return [part] if part[-2:] in pairs or len(part) < 2 else [part[:-1], part[-1]]
        cuts = [i for i, pair in enumerate(map(str.__add__, part, part[1:]), 1) if pair not in pairs]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]

    def row(self, part: str) -> bytes:
        """Ids of one part in decimal, by an agenda for each stretch that has not been met before."""
        out = []
        for stretch in self.split(part):
            known = self.parts.get(stretch) or self.stretches.get(stretch)
            if known is None:
                known = b"".join(map(self.decimal.__getitem__, self.agenda(stretch)))
                if len(stretch) <= CACHE_CHARS and len(stretch) < len(part):       # whole parts get their own entry
                    self.stretches[stretch] = known
            out.append(known)
        return b"".join(out)

    def add(self, parts: list[str]) -> None:
        """Put parts into the tables after a check of their ids and their decoded text against the library."""
        rows = [self.row(p) for p in parts]
        if self.guard is None:
            expected, texts = [[*map(int, r.split())] for r in rows], [None] * len(parts)
        else:
            first = len(self.library.encode([self.guard])[0])
            expected = self.library.encode([self.guard + p for p in parts], num_threads=1)
            texts = self.library.decode(expected, num_threads=1)
            expected = [e[first:] for e in expected]
        decimal, raws = self.decimal.__getitem__, self.raw.__getitem__
        for part, row, want, text in zip(parts, rows, expected, texts):
            right, raw, wrong = b"".join(map(decimal, want)), b"".join(map(raws, want)), 0
            if row != right:
                row, wrong = right, 1
            if text is not None and raw != (right := text.encode()[1:]):
                raw, wrong = right, 1
            self.parts[part] = row
            if wrong or raw != part.replace(SPACE, " ").encode():
                self.odd[part] = raw, wrong

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, int]]:
        """Per text: the ids in decimal (each followed by a space), decoded text, corrections."""
        if max(len(self.parts), len(self.stretches)) > CACHE_PARTS:
            for table in (self.parts, self.stretches, self.odd):
                table.clear()
        held = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        unknown: set[str] = set()
        for parts in held:
            unknown.update(parts)
        unknown -= self.parts.keys()
        self.add(list(unknown))
        row = self.parts.__getitem__
        for parts in held:
            if self.odd and not self.odd.keys().isdisjoint(parts):
                own = [self.odd.get(p) or (p.replace(SPACE, " ").encode(), 0) for p in parts]
                text, wrong = b"".join([x[0] for x in own]), sum([x[1] for x in own])
            else:
                text, wrong = "".join(parts).replace(SPACE, " ").encode(), 0
            yield b"".join(map(row, parts)), text[1:], wrong        # without the space put before
        for part in unknown:
            if len(part) > CACHE_CHARS:
                del self.parts[part]
                self.odd.pop(part, None)


def piece_model(path: str) -> PieceModel:
    """The worker process's model for a file."""
    held = worker_state("pieces")
    if path not in held:
        held[path] = PieceModel(path)
    return held[path]


def _grouped(texts: pa.Array, limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about ``limit`` characters."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        text = t.as_py()
        run.append(text)
        size += len(text or "") + 1
        if size > limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id), decoded text and n_corrected of every document."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def make():
        model = piece_model(path)

        def compute(batch: pa.RecordBatch):
            ids, text, wrong = [], [], []
            for run in _grouped(batch.column("text")):
                for row, raw, bad in model.encode_batch(run):
                    ids.append([*map(int, row.split()), model.end])
                    text.append(raw.decode())
                    wrong.append(bad)
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string()), pa.array(wrong, pa.int64())]
        return compute
    return map_columns(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"],
                       [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string()),
                        ("n_corrected", "bigint", pa.int64())], make)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: n_tokens (with the end id), digests of its ids and its decoded text, n_corrected."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def make():
        model = piece_model(path)
        end = b"%d" % model.end

        def compute(batch: pa.RecordBatch):
            out: list[list] = [[], [], [], []]
            for run in _grouped(batch.column("text")):
                for row, raw, bad in model.encode_batch(run):
                    for column, x in zip(out, (row.count(b" ") + 1, hashlib.sha256(row + end).hexdigest(),
                                               hashlib.sha256(raw).hexdigest(), bad)):
                        column.append(x)
            return [pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2]), pa.array(out[3], pa.int64())]
        return compute
    return map_columns(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"],
                       [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()),
                        ("decoded_sha256", "string", pa.string()), ("n_corrected", "bigint", pa.int64())], make)
