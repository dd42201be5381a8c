"""Vectorised text kernels shared by the corpus operators.

Every function works on one *chunk*: the UTF-8 bytes of a run of whole documents (or, for
byte-level work, of a slice of one document) laid end to end with one separator byte between
them. A chunk holds about ``CHUNK_BYTES`` bytes, or one document if that is longer, so a
Python worker needs a few dozen times that size, whatever the partition holds.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_PRIME_INV = pow(_PRIME, -1, 1 << 64)


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks of many operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker process, for caches that tasks share.

    Operator code is pickled by value, so its own module globals are new in every task.
    """
    home = sys.modules.setdefault("piisieve_worker_state", types.ModuleType("piisieve_worker_state"))
    return home.__dict__.setdefault(name, {})


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(c)) for c in range(256)])


#: words ``[^\x20\x09-\x0D]+``: everything but ASCII white space
BLANK = _table(lambda c: not (c == 0x20 or 0x09 <= c <= 0x0D))
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: 0-9, a-z, non-ASCII
ALNUM = _table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
#: bytes with A-Z lower-cased
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def powers(n: int, prime: int = _PRIME) -> np.ndarray:
    """prime ** 0 .. prime ** (n - 1), modulo 2 ** 64."""
    held = worker_state("powers")
    have = held.get(prime)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, _U(prime), dtype=_U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        held[prime] = have
    return have[:n]


def word_bounds(buf: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every maximal run of bytes in ``keep``."""
    on = np.zeros(len(buf) + 2, dtype=np.int8)
    on[1:-1] = keep[buf]
    edge = np.diff(on)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span; equal bytes give equal hashes in any chunk."""
    total = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(_BYTE[buf] * powers(len(buf)), dtype=_U, out=total[1:])
    inverse = powers(len(buf) + 1, _PRIME_INV)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, by its first word (none for shorter input)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    total = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * powers(len(words)), dtype=_U, out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(n, _PRIME_INV))


def range_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the word hashes of each range, the same wherever the range lies."""
    total = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * powers(len(words)), dtype=_U, out=total[1:])
    return mix((total[end] - total[start]) * powers(len(words) + 1, _PRIME_INV)[start] + (end - start).astype(_U))


class Chunk:
    """Bytes of whole documents; document i is ``data[starts[i]:ends[i]]``."""

    __slots__ = ("data", "starts", "ends", "first", "n")

    def __init__(self, texts: list[bytes], first: int):
        self.first, self.n = first, len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def words(self, keep: np.ndarray, data: np.ndarray | None = None):
        """Word starts and ends, and the word range of each document (n + 1 bounds)."""
        start, end = word_bounds(self.data if data is None else data, keep)
        return start, end, np.append(np.searchsorted(start, self.starts), len(start))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole documents of a text column in chunks; a null text counts as empty."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
        if held and size + len(raw) > limit:
            yield Chunk(held, first)
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield Chunk(held, first)
    release()
