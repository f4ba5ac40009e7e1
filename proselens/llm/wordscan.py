"""Vectorised word scanning of Arrow string columns.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.  Every byte of a
multi-byte UTF-8 sequence is 0x80 or more, so the class can be decided byte by byte, exactly.
Word hashes come from one polynomial prefix sum over the bytes (arithmetic modulo 2**64), so the cost is a few
array operations per byte whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

WORD_BYTES = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    WORD_BYTES[_b] = _b
for _b in range(0x41, 0x5B):
    WORD_BYTES[_b] = _b + 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64 (kept, and grown on demand)."""
    if n > len(_powers.get("up", ())):
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold at most ``limit`` bytes (a longer text stands alone)."""
    _, offsets = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """Words of a run of texts: text number, first and end byte (in the run) and hash of each word."""

    flat: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.offsets) - 1)


def scan(column: pa.Array) -> Words:
    flat, offsets = raw(column)
    n = len(flat)
    low = WORD_BYTES[flat]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = low > 0
    fence = np.zeros(n + 1, bool)
    fence[offsets] = True
    start = np.flatnonzero(inside[1:] & (fence | ~inside[:-1]))
    end = np.flatnonzero(inside[:-1] & (fence | ~inside[1:]))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[:n], out=total[1:])
    return Words(low, offsets, np.searchsorted(offsets, start, side="right") - 1, start, end, mix((total[end] - total[start]) * down[start]))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``size`` words; a text of fewer words, but not none, is one run."""
    h, n = words.hash, len(words.hash)
    counts = words.counts
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    left = (first + counts)[words.text] - np.arange(n)
    keep = (left >= size) | ((np.arange(n) == first[words.text]) & (counts[words.text] < size))
    at = np.flatnonzero(keep)
    out = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for j in range(size):
        there = left[at] > j
        out[there] = mix(out[there] * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + j, n - 1)][there])
    return words.text[at], out
