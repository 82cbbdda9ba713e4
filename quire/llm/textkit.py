"""Vectorised words and hashes over the bytes of an Arrow string column.

Every function works on blocks of whole rows of about ``BLOCK`` bytes, so the
memory needed follows the block (or one row, where a row is longer), never the
Arrow batch.  Words are found on UTF-8 bytes; A-Z count as a-z through the hash
table, so no lower-cased copy of the text is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RNG = np.random.default_rng(20240229)
#: One random 64-bit value for each byte; A-Z share those of a-z.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_MASK = 2**64 - 1

#: Bytes of words that white space ends: everything but 0x20 and 0x09-0x0D.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits: 0-9, A-Z, a-z and all of 0x80 and up.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x41:0x5B] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; afterwards the worker, which waits for its next task, gives back what it doesn't use."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own counsel
            return

    return wrapped


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, BLOCK + 16)
        table = np.ones(1, dtype=np.uint64)
        while len(table) < size:
            step = np.uint64(pow(base, len(table), 2**64))
            table = np.concatenate([table, table * step])
        _powers[base] = table
    return table[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offsets = column_bytes(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for each row, the range of words it holds."""
    inside = kind[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for words that differ in A-Z only by case."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power_table(_BASE, n), out=sums[1:])
    poly = (sums[ends] - sums[starts]) * _power_table(_BASE_INV, n + 1)[starts]
    return mix(poly + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words by its first word; rows are not told apart."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    step = 1
    for j in range(k):
        total += words[j : j + n] * np.uint64(step)
        step = step * 0xA0761D6478BD642F & _MASK
    return mix(total, seed=k)


def row_runs(words: np.ndarray, ranges: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its run hashes; a row of fewer words, but some, is one run."""
    runs = run_hashes(words, k)
    for lo, hi in zip(ranges[:-1].tolist(), ranges[1:].tolist()):
        if hi - lo >= k:
            yield runs[lo : hi - k + 1]
        elif hi > lo:
            yield run_hashes(words[lo:hi], hi - lo)
        else:
            yield runs[:0]
