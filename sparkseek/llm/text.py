"""Vectorised primitives over Arrow string columns: bytes, words and their hashes, without Python strings.

A *word* is a maximal run of bytes other than ASCII white space; hashes are 64 bits wide and depend on the
word's bytes alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

R = 0x9E3779B97F4A7C15 | 1
R_INV = pow(R, -1, 1 << 64)
CHUNK = 1 << 18  # bytes that are worked on at once

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^0..R^(n-1) and their inverses modulo 2^64; those beyond what parts() usually gives aren't kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for r in (R, R_INV):
        a = np.full(max(n, 1 << 16), r, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    if len(out[0]) <= 2 * CHUNK:
        _powers[:] = out
    return out[0][:n], out[1][:n]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Gives memory that is free back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(f):
    """f for an Arrow UDF, with its free memory given back after each batch."""

    @functools.wraps(f)
    def run(*columns):
        try:
            return f(*columns)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n+1 offsets into them; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    n = len(a)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


def parts(data: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [i, j) of about `limit` bytes (a longer row comes alone), with their bytes and offsets."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's offset into the words."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= solid[cuts]
    last[cuts - 1] |= solid[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, then what word_bounds gives."""
    starts, ends, rows = word_bounds(data, off)
    p, q = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts]), starts, ends, rows


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the caller drops the runs that cross rows. Empty with fewer than k words."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * p[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n + 1 - k]) * q[: n + 1 - k])


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i, 0 where empty; independent of the rows around."""
    out = np.zeros(len(off) - 1, np.float64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out


def ragged(values: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments values[off[i]:off[i+1]] for i in `which`, in one piece, and the offsets into it."""
    n = off[which + 1] - off[which]
    out = np.concatenate([[0], np.cumsum(n)])
    return values[np.arange(out[-1]) - np.repeat(out[:-1] - off[which], n)], out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    p, q = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    own = sums[1:]
    np.add(data, np.uint64(1), out=own)
    own *= p[: len(data)]
    np.cumsum(own, out=own)
    return mix((sums[ends] - sums[starts]) * q[starts])
