"""Vectorised work on the UTF-8 bytes of many texts at once.

Arrow hands a batch of texts as one byte buffer with offsets. These helpers find
and hash words over that whole buffer with numpy, so Python's cost is per batch
and not per row. A slice of a batch is bounded in bytes, which bounds memory; a
single text above the bound makes a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64

_gen = np.random.Generator(np.random.PCG64(20240517))
BYTE_CODE = _gen.integers(1, 2**64, size=256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=np.uint8)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = 0

BASE = U(0x9E3779B97F4A7C15)
_inverse = U(pow(int(BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, _inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a column of texts; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``limit`` bytes, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i], modulo 2**64."""
    p, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODE[data] * p[: len(data)], out=out[1:])
    return out


def spans(data: np.ndarray, off: np.ndarray, wanted: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of wanted bytes; a run ends with its text.

    ``off`` are offsets into ``data`` that begin at 0.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_in = wanted[data]
    edge = np.zeros(n + 1, np.uint8)
    edge[1:] = is_in
    inner = off[:-1][off[:-1] < off[1:]]
    before = edge[:-1].copy()
    before[inner] = 0
    starts = np.flatnonzero(is_in > before)
    after = np.zeros(n, np.uint8)
    after[:-1] = is_in[1:]
    after[off[1:][off[:-1] < off[1:]] - 1] = 0
    return starts, np.flatnonzero(is_in > after) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]."""
    h = prefix_hash(data)
    _, inv = powers(len(data) + 1)
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, and where each text's words begin.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.
    """
    low = LOWER[data]
    s, e = spans(low, off)
    return span_hash(low, s, e), np.searchsorted(s, off)


def shingles(tok: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words and where each text's shingles begin.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    n_tok = np.diff(at)
    count = np.where(n_tok >= width, n_tok - width + 1, (n_tok > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(count)))
    total = int(begin[-1])
    first = np.repeat(at[:-1] - begin[:-1], count) + np.arange(total)
    last = np.repeat(at[1:], count)
    acc = np.zeros(total, np.uint64)
    for k in range(width):
        ok = first + k < last
        word = np.zeros(total, np.uint64)
        word[ok] = tok[(first + k)[ok]]
        acc = acc * U(0xD6E8FEB86659FD93) + word
    return mix(acc), begin


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches, limit: int = SLICE_BYTES, col: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with the bytes and offsets (from 0) of one column."""
    for batch in batches:
        data, off = buffers(batch.column(batch.schema.get_field_index(col)))
        for i, j in slices(off, limit):
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        del batch, data, off
    release()
