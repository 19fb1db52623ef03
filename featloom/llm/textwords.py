"""Words of whole Arrow batches and their hashes, without a Python loop over words.

A word is a run of characters other than space and the ASCII controls 9 to 13. UTF-8 keeps these
bytes for these characters alone, so texts are cut on their bytes. A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes that part words.
BLANKS = b" \t\n\v\f\r"
# Bytes hashed at once; longer single words make a longer piece.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit integers; ``salt`` gives independent values."""
    x = x + np.uint64((salt * 0xA0761D6478BD642F + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(256, dtype=np.uint64), 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` or more of each."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, PIECE), factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row where its words begin (and the last end)."""
    inside = ~_IS_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]  # a row border parts words, too
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, then mixed."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        powers, inverse = _tables(n := int(ends[j - 1] - base))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_OF_BYTE[data[base:base + n]] * powers[:n], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD)
        i = j
    return out


def window_hashes(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values, by doubling; shorter by ``size`` - 1."""
    factor, run, power = int(mix(np.array([salt], np.uint64), 7)[0]) | 1, mix(hashes, salt), 1
    out, have = None, 0
    while True:
        if size & power:
            if out is None:
                out = run
            else:  # the windows so far, then this run behind them
                n = len(hashes) - have - power + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] + np.uint64(pow(factor, have, 2**64)) * run[have:have + n]
            have += power
        if have == size:
            return mix(out[:max(0, len(hashes) - size + 1)], salt)
        n = len(run) - power
        if n <= 0:
            return np.zeros(0, np.uint64)
        run, power = run[:n] + np.uint64(pow(factor, power, 2**64)) * run[power:], power * 2


def window_starts(word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window lies within its row, and the row of each."""
    counts = np.maximum(np.diff(word_offsets) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(rows)) - np.repeat(before - word_offsets[:-1], counts), rows


def pieces(batch: pa.RecordBatch, text: int, limit: int = 4 << 20):
    """Consecutive slices of a batch with about ``limit`` bytes of text each, and one row at least."""
    _, offsets = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
