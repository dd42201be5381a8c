"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut where the tokenizer's own pre-tokenizer always cuts, before a run of ASCII white
space that follows another character, so a piece's ids do not depend on its neighbours. Piece
hashes are looked up in a worker-wide cache of at most ``CACHE_PIECES`` pieces (then it starts
anew); only unknown pieces reach the library, joined to longer texts, as a call per piece costs more
than its ids. Texts with other white space characters, where a cut could split one run of white
space, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .textops import BLANK, Chunk, span_hash, worker_state

CACHE_PIECES = 1_500_000
#: UTF-8 of the white space (and zero-width) characters beyond ASCII, by first byte: (second, third) bytes
_WIDE = {0xc2: [((0x85, 0xa0), None)], 0xe1: [((0x9a,), (0x80,)), ((0xa0,), (0x8e,))],
         0xe2: [((0x80,), (*range(0x80, 0x90), 0xa8, 0xa9, 0xaf)), ((0x81,), (0x9f, 0xa0))],
         0xe3: [((0x80,), (0x80,))], 0xef: [((0xbb,), (0xbf,))], **{c: None for c in range(0x1c, 0x20)}}
_LEADS = np.array([c in _WIDE for c in range(256)])
#: a character of one id that stands between joined pieces, with white space around it
_MARK = 1
_ENCODE = 1024


def tokenizer_path(name: str) -> str:
    """The vocabulary file of an installed public tokenizer."""
    import public_tokenizers
    return public_tokenizers.path(name)


def wide_places(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins in UTF-8 bytes."""
    at = np.flatnonzero(_LEADS[data])
    if not len(at):
        return at
    lead, second, third = (data[np.minimum(at + i, len(data) - 1)] for i in range(3))
    hit = np.zeros(len(at), dtype=bool)
    for byte, rest in _WIDE.items():
        own = lead == byte
        if rest is None:
            hit |= own
        elif own.any():
            for seconds, thirds in rest:
                hit |= own & np.isin(second, seconds) & (True if thirds is None else np.isin(third, thirds))
    return at[hit]


class PieceTokenizer:
    """Encodes chunks with one vocabulary file. ``spaces``: white space is part of the tokens."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.spaces = spaces
        self.mark, self.widths = None, None
        if spaces:          # the bytes of each id, where an id stands for its own bytes and nothing else
            with open(path, encoding="utf-8") as file:
                parts = json.load(file)
            if parts["normalizer"] is None and (parts["pre_tokenizer"] or {}).get("type") == "ByteLevel" \
                    and not parts["pre_tokenizer"]["add_prefix_space"]:
                vocabulary = self.model.get_vocab()
                self.widths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
                self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        else:
            ids = self.model.encode(chr(_MARK), add_special_tokens=False).ids
            self.mark = ids[0] if len(ids) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)      # sorted by key
        self.new_keys, self.new_rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.sizes, self.offsets = np.empty(0, np.int32), np.empty(0, np.int64)
        self.pool = np.empty(1 << 16, np.uint16)
        self.filled = 0

    def encode(self, chunk: Chunk, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk, each followed by ``end_id``, and their n + 1 bounds."""
        start, end, bound = chunk.words(BLANK)
        if self.spaces:          # a piece: the white space before a word and the word, or what is left
            last = np.append(-1, end)
            first_of_doc = np.zeros(len(start) + 1, dtype=bool)
            first_of_doc[bound[:-1]] = True
            from_ = last[:-1].copy()
            some = np.diff(bound) > 0
            from_[bound[:-1][some]] = chunk.starts[some]
            tail = np.where(some, last[bound[1:]], chunk.starts)
            left = chunk.ends > tail
            start = np.append(from_, tail[left])
            end = np.append(end, chunk.ends[left])
            owner = np.append(np.repeat(np.arange(chunk.n), np.diff(bound)), np.flatnonzero(left))
            order = np.argsort(start, kind="stable")
            start, end, owner = start[order], end[order], owner[order]
        else:
            owner = np.repeat(np.arange(chunk.n), np.diff(bound))
        wide = wide_places(chunk.data)
        rows = self._rows(chunk, span_hash(chunk.data, start, end), start, end, wide)
        sizes = self.sizes[rows].astype(np.int64)
        bounds = np.append(0, np.cumsum(np.bincount(owner, weights=sizes, minlength=chunk.n).astype(np.int64)))
        flat = self.pool[np.arange(sizes.sum()) + np.repeat(self.offsets[rows] - (np.cumsum(sizes) - sizes), sizes)]
        flat = np.insert(flat, bounds[1:], end_id) if chunk.n else flat
        bounds = bounds + np.arange(chunk.n + 1)
        if len(wide):
            parts = [flat[bounds[i]:bounds[i + 1]] for i in range(chunk.n)]
            for i in np.unique(np.searchsorted(chunk.starts, wide, side="right") - 1).tolist():
                text = chunk.data[chunk.starts[i]:chunk.ends[i]].tobytes().decode()
                ids = self.model.encode(text, add_special_tokens=False).ids
                parts[i] = np.array(ids + [end_id], dtype=np.uint16)
            flat = np.concatenate(parts)
            bounds = np.append(0, np.cumsum([len(p) for p in parts]))
        return flat, bounds

    def _rows(self, chunk: Chunk, hashes, start, end, wide) -> np.ndarray:
        """Cache row of each piece, after encoding those that are new."""
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self._known(unique)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            if len(self.sizes) + len(unknown) > CACHE_PIECES and len(self.sizes):
                self.clear()
                return self._rows(chunk, hashes, start, end, wide)
            joins = self._joins(chunk.data, start[first[unknown]], end[first[unknown]], wide)
            unknown = np.append(unknown[joins], unknown[~joins])
            rows[unknown] = len(self.sizes) + np.arange(len(unknown))
            raw = chunk.data.tobytes()
            at = first[unknown]
            texts = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            self._add(texts, int(joins.sum()))
            keys = np.append(self.new_keys, unique[unknown])
            order = np.argsort(keys, kind="stable")
            self.new_keys, self.new_rows = keys[order], np.append(self.new_rows, rows[unknown])[order]
            if len(self.new_keys) > 20_000 + len(self.keys) // 8:
                keys = np.append(self.keys, self.new_keys)
                order = np.argsort(keys, kind="stable")
                self.keys, self.rows = keys[order], np.append(self.rows, self.new_rows)[order]
                self.new_keys, self.new_rows = self.new_keys[:0], self.new_rows[:0]
        return rows[back]

    def _known(self, unique: np.ndarray) -> np.ndarray:
        out = np.full(len(unique), -1, dtype=np.int64)
        for keys, rows in ((self.keys, self.rows), (self.new_keys, self.new_rows)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
                hit = keys[at] == unique
                out[hit] = rows[at[hit]]
        return out

    def _joins(self, data: np.ndarray, start, end, wide) -> np.ndarray:
        """Which pieces keep their ids, and can be told apart, where they are joined."""
        if self.widths is not None:
            fit = ~BLANK[data[start]] & BLANK[data[end - 1]]        # white space, then a word
            barred = wide
        elif self.mark is not None:
            fit = np.ones(len(start), dtype=bool)
            barred = np.union1d(wide, np.flatnonzero(data == _MARK))
        else:
            return np.zeros(len(start), dtype=bool)
        return fit & (np.searchsorted(barred, start) == np.searchsorted(barred, end))

    def _add(self, texts: list[bytes], joined: int) -> None:
        """Keep the ids of new pieces; the first ``joined`` of them may be joined."""
        found = []
        for i in range(0, joined, _ENCODE):
            own = texts[i:min(joined, i + _ENCODE)]
            found.append(self._together(own) or self._apart(own))
        for i in range(joined, len(texts), _ENCODE):
            found.append(self._apart(texts[i:i + _ENCODE]))
        flat, sizes = (np.concatenate(x) for x in zip(*found))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.empty(len(self.pool), np.uint16))
        self.pool[self.filled:self.filled + len(flat)] = flat
        self.offsets = np.append(self.offsets, self.filled + np.cumsum(sizes, dtype=np.int64) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.filled += len(flat)

    def _apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        return np.fromiter((x for own in ids for x in own), dtype=np.uint16, count=int(sizes.sum())), sizes

    def _together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of pieces encoded as one text; None if their bounds are not all found in it."""
        glue = b"" if self.mark is None else b" %c " % _MARK
        encoding, = self.model.encode_batch_fast([glue.join(texts).decode()], add_special_tokens=False)
        ids = np.array(encoding.ids, dtype=np.uint16)
        if self.mark is not None:
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(texts) - 1:
                return None
            sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            return ids[ids != self.mark], sizes.astype(np.int32)
        bytes_to = np.append(0, np.cumsum(self.widths[ids]))
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))))
        at = np.searchsorted(bytes_to, bounds)
        if bytes_to[-1] != bounds[-1] or not (bytes_to[at] == bounds).all():
            return None
        return ids, np.diff(at).astype(np.int32)


def shared_tokenizer(path: str, spaces: bool) -> PieceTokenizer:
    """The worker process's tokenizer for a vocabulary file."""
    held = worker_state("tokenizers")
    if path not in held:
        held[path] = PieceTokenizer(path, spaces)
    return held[path]
