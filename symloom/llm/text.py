"""Vectorised tokenising and hashing of Arrow text columns.

All functions work on UTF-8 bytes of a whole column slice at once; no Python loop runs per
word.  Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # arrays of 64 bits a byte are made of a chunk, a dozen at a time
SHINGLE = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (shift, xor, multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        have = np.full(size, _BASE_INV if inverse else _BASE, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[key] = have
    return have[:n]


def range_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see ``between``."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data)), out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes ``start..end`` from ``range_hash``, independent of where they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start] + (end - start).astype(_U))


def slices(column: pa.Array, rows: int = 65536) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row slices of a string column, about ``CHUNK_BYTES`` and at most ``rows`` each: first row, bytes, row offsets.

    Nulls are empty; one row is never split.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(column), row + rows)
        yield row, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone


def release() -> None:
    """Gives what this process has freed back to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(work: Callable) -> Callable:
    """``work`` for ``mapInArrow`` or ``applyInArrow`` (of a table, or key and table) that ends with ``release``.

    Groups under ``CHUNK_BYTES`` don't, as there may be very many of them.
    """

    def of_key_and_table(key, t):
        out = work(key, t)
        if t.nbytes >= CHUNK_BYTES:
            release()
        return out

    def of_one(given):
        out = work(given)
        if not isinstance(given, pa.Table):
            return ended(out)
        if given.nbytes >= CHUNK_BYTES:
            release()
        return out

    return of_key_and_table if work.__code__.co_argcount - len(work.__defaults__ or ()) == 2 else of_one


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    release()


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values are turned into Python objects."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


class Words:
    """Words of one slice: byte ``start`` and ``end``, ``hash``; ``first[d]:first[d+1]`` are document d's."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, hashed: bool = True):
        n = len(data)
        self.lower = _LOWER[data]
        black = ~_SPACE[data]
        opens = black.copy()
        opens[1:] &= ~black[:-1]
        heads = offs[:-1][offs[:-1] < n]
        opens[heads] = black[heads]
        closes = black.copy()
        closes[:-1] &= opens[1:] | ~black[1:]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.docs = len(offs) - 1
        if hashed:
            self.prefix = range_hash(self.lower)
            self.hash = between(self.prefix, self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.count)

    def grams(self, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and first word (counted in its document) of every run of k words.

        A document of fewer than k words, but some, has one run: all of them.
        """
        count, first, n = self.count, self.first, len(self.hash)
        runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(self.docs), runs)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        word = first[:-1][doc] + at
        acc = np.zeros(len(doc), _U)
        short = count[doc] < k
        some_short = bool(short.any())
        for j in range(k):
            place = _U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))  # powers, as sums over an even spacing would collide
            if some_short:
                inside = j < count[doc]
                acc += np.where(inside, self.hash[np.minimum(word + j, max(n - 1, 0))] * place, place)
            elif len(word):
                acc += self.hash[word + j] * place
        if some_short:
            acc += np.where(short, count[doc], 0).astype(_U)
        return mix(acc), doc, at


def per_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Bounds of each document's part of ``values``, which are in order of document."""
    return np.searchsorted(doc, np.arange(docs + 1))


def distinct(values: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, end to end, and the bounds of each document's."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, per_doc(values, doc, docs)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
