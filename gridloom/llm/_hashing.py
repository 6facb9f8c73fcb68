"""Word hashes for whole Arrow batches of texts, in numpy, without a Python object for each word.

A text's bytes go through a table of fixed random 64-bit numbers; prefix sums weighted by powers of an odd
base give the hash of any byte range, taken modulo 2**64. A sum of powers modulo 2**64 cannot tell some long
strings of repeating structure apart, so words beyond ``LONG_WORD`` bytes are hashed by xxh3 instead. Words are the
runs of bytes other than 0x20 and 0x09-0x0D, which are never part of a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 4
_BLOCK = 1 << 20
LONG_WORD = 48
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1B54A32D192ED03))
    lower = values.copy()
    lower[65:91] = values[97:123]
    return values, lower


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n + 1, _BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, U64(base), np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    values = _tables()[1 if lower else 0]
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]
        out = mix(h ^ ((end - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(end - start > LONG_WORD):
        word = data[start[i] : end[i]]
        word = np.where((word >= 65) & (word <= 90), word + 32, word).astype(np.uint8) if lower else word
        out[i] = xxhash.xxh3_64_intdigest(word.tobytes())
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends in the bytes, in order, and the number of words of each row."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = ~_space()[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:] - 1
    lasts = lasts[lasts >= 0]
    ends[lasts] = inside[lasts]
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, in order, and the number of words of each row."""
    start, end, counts = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    if len(data) <= _BLOCK:
        return _span_hashes(data, start, end, lower), counts
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # blocks of words, to bound the 64-bit arrays
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, side="right")))
        lo, hi = start[i], end[j - 1]
        out[i:j] = _span_hashes(data[lo:hi], start[i:j] - lo, end[i:j] - lo, lower)
        i = j
    return out, counts


def slices(batch: pa.RecordBatch, column: int, nbytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most about ``nbytes`` of text each, one row at least."""
    _, offsets = text_buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + nbytes, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
