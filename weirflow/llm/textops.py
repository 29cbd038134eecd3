"""Vectorised text kernels shared by the Arrow-batched operators.

Everything works on one flat UTF-8 buffer plus row offsets, so that a batch costs a few numpy
passes instead of a Python loop over words. Words are maximal runs of bytes other than space and
\\x09-\\x0D; multi-byte characters never contain those bytes, so byte and code-point splitting agree.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PART_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDLIKE = np.ones(256, bool)
_WORDLIKE[:128] = [chr(c).isalnum() or c == 95 for c in range(128)]
_BASE = 0x9E3779B97F4A7C15 | 1


class Words(NamedTuple):
    """Word byte spans of a part; words of row i are `off[i]:off[i+1]`."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray


def text_parts(column: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of whole rows, about `part_bytes` each; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + part_bytes, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    if offsets[-1] - offsets[0] > PART_BYTES:
        trim()


def trim() -> None:
    """Give freed memory back to the system: Python workers live on from one stage to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release() -> None:
    """Drop the hash tables, which the next hashing makes again, and trim."""
    global _POWERS
    _POWERS = (np.zeros(0, U64), np.zeros(0, U64))
    trim()


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~_SPACE[buf]
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    finishes[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    begins[head] = solid[head]
    finishes[tail] = solid[tail]
    starts = np.flatnonzero(begins)
    return Words(buf, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets))


def normal(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case (A-Z and the Latin-1 letters) without ASCII punctuation; words of punctuation alone are left out."""
    low = lower_ascii(buf)
    upper = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)) + 1
    low[upper] += 0x20
    w = words_of(low, offsets)
    solid = _WORDLIKE[low]
    place = np.concatenate([[0], np.cumsum(solid)])
    starts, ends = place[w.starts], place[w.ends]
    keep = ends > starts
    return Words(low[solid], starts[keep], ends[keep], np.concatenate([[0], np.cumsum(keep)])[w.off])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, PART_BYTES + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _POWERS = tuple(tables)
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U64), np.zeros(0, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so it adds no collisions."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    power, _ = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[: len(buf)], out=sums[1:])
    return sums


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial from prefix sums, then `mix` with the length."""
    if not len(starts):
        return np.zeros(0, U64)
    sums = prefix_sums(buf) if sums is None else sums
    _, inverse = _power_tables(len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def hash_word(word: str | bytes) -> int:
    raw = np.frombuffer(word if isinstance(word, bytes) else word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


_STEP = U64(0xD6E8FEB86659FD93)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each row's k-word shingles; a shorter row has its whole sequence as one."""
    n = len(h)
    count = np.diff(off)
    acc = np.zeros(max(0, n - k + 1), U64)
    for i in range(k):
        acc = acc * _STEP + h[i : i + len(acc)]
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_off = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(count)), made)
    at = off[:-1][row] + np.arange(len(row)) - out_off[:-1][row]
    out = np.zeros(len(row), U64)
    long = (count >= k)[row]
    out[long] = acc[at[long]]
    for i in np.flatnonzero((count > 0) & (count < k)):
        v = int(count[i])
        for x in h[off[i] : off[i + 1]]:
            v = (v * 0xA24BAED4963EE407 + int(x)) & 0xFFFFFFFFFFFFFFFF
        out[out_off[i]] = v ^ 0x5851F42D4C957F2D
    return mix(out), out_off


def row_sets(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    values = values.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[off[:-1][off[:-1] < len(values)]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[off]
