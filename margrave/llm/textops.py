"""Vectorised word operations on Arrow string buffers.

Texts stay the UTF-8 bytes Arrow delivers: word bounds and word hashes come from whole-array numpy
operations, with no Python object per word. Memory is bounded by handling SLICE bytes of text at a time
(a longer single text is a slice of its own).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa

SLICE = 2 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Words are separated by space, tab, line feed, vertical tab, form feed and carriage return.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_IS_SPACE] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE)
        for i, base in enumerate((_BASE, _BASE_INV)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[i] = out
    return _powers


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


@functools.cache
def _one_thread() -> None:
    """Keep numpy's matrix products to the task's own core: a worker runs on each core, and further threads of OpenBLAS only spin."""
    maps = Path("/proc/self/maps")
    libraries = {line.split(None, 5)[-1].strip() for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ()
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def trimmed(f: Callable) -> Callable:
    """f, of one or two Arrow tables, which afterwards gives freed memory back to the system: idle Python workers would keep it."""

    def run(*tables):
        _one_thread()
        try:
            return f(*tables)
        finally:
            if sum(t.nbytes for t in tables) > 1 << 20:
                _trim()

    return (lambda t: run(t)) if f.__code__.co_argcount == 1 else (lambda left, right: run(left, right))


def lean(f: Callable) -> Callable:
    """f, a map over Arrow batches, which at its end gives freed memory back to the system."""

    def run(batches):
        _one_thread()
        try:
            yield from f(batches)
        finally:
            _trim()

    return run


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n, (_, off, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many texts, of at most limit bytes together or of one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """White-space separated words of each text, with a 64-bit hash of each word's bytes (A-Z as a-z if lower)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(0, np.uint64))
    word = ~_IS_SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[word[cut - 1] & word[cut]]  # a word that would run from one text into the next
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, np.repeat(np.unique(cut), 2)]), kind="stable")
    start, end = at[0::2], at[1::2]
    doc = np.searchsorted(offsets, start, "right") - 1
    power, inverse = _powers_to(n)
    h = np.add.reduceat((_BYTE_LOWER if lower else _BYTE)[data] * power[:n], start) if len(start) else np.zeros(0, np.uint64)
    h = mix(h * inverse[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return Words(data, offsets, start, end, doc, h)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of integer values; runs lie end to end and cover all values."""
    power, inverse = _powers_to(len(values))
    h = np.add.reduceat(mix(values) * power[: len(values)], start) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def window_checks(w: Words, k: int) -> np.ndarray:
    """A second, independent hash of 16 bits of each window that windows(w, k) gives."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint16)
    other = (mix(w.hash, 5) >> _U(32)).astype(np.uint32) | np.uint32(1)
    roll = other[: n - k + 1].copy()
    for j in range(1, k):
        roll *= np.uint32(0x9E3779B1)
        roll += other[j : n - k + 1 + j]
    return (mix(roll[w.doc[k - 1 :] == w.doc[: n - k + 1]].astype(np.uint64), 6) >> _U(48)).astype(np.uint16)


def windows(w: Words, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and rolling polynomial hash of each window of k words of one text; a text of fewer words, but not none, is one window if whole."""
    n = len(w.hash)
    first, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= k:
        first = np.flatnonzero(w.doc[k - 1 :] == w.doc[: n - k + 1])
        roll = w.hash[: n - k + 1].copy()
        for j in range(1, k):
            roll *= _U(0x2545F4914F6CDD1D)
            roll += w.hash[j : n - k + 1 + j]
        h = mix(roll[first], k)
    if whole and n:
        count = w.counts()
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            roll = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                more = count[short] > j
                roll[more] = roll[more] * _U(0x2545F4914F6CDD1D) + w.hash[begin[short[more]] + j]
            first = np.concatenate([first, begin[short]])
            h = np.concatenate([h, mix(roll ^ mix(count[short].astype(np.uint64), 77), k)])
    return first, h


def covered(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words starting at one of first (merged intervals)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + k, n), -1)
    return np.cumsum(step[:n]) > 0


def join_kept(w: Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    n = len(w.data)
    step = np.zeros(n + 1, np.int8)
    step[w.start[kept]] += 1
    step[w.end[kept]] -= 1
    take = np.cumsum(step[:n], dtype=np.int8).astype(bool)
    out, kdoc = w.data.copy(), w.doc[kept]
    later = np.ones(len(kdoc), bool)
    if len(kdoc):
        later[1:] = kdoc[1:] == kdoc[:-1]
        later[0] = False
    gap = w.start[kept][later] - 1  # the separator before a kept word that isn't its text's first
    take[gap] = True
    out[gap] = 32
    size = np.concatenate([[0], np.cumsum(take, dtype=np.int64)])[w.offsets]
    return pa.Array.from_buffers(pa.large_string(), w.docs, [None, pa.py_buffer(np.ascontiguousarray(size)), pa.py_buffer(out[take])])
