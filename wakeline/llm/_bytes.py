"""Texts as UTF-8 bytes in NumPy arrays: pieces of Arrow batches, words and their hashes.

Hashes are polynomials over random 64-bit values, modulo 2**64, put through a mixer; the hash of any run of bytes or
words is a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on this many bytes at a time (one text at least).
PIECE_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column in a row, and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) for rows first to end - 1, of about ``most`` bytes together."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def each(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, bytes, offsets) for every single text, empty ones too."""
    data, offsets = utf8(column)
    for i in range(len(offsets) - 1):
        own = data[offsets[i] : offsets[i + 1]]
        yield i, own, np.array([0, len(own)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of runs of a sequence of 64-bit values."""

    def __init__(self, seed: int) -> None:
        made = mix(np.arange(1, 260, dtype=np.uint64) + np.uint64(seed * 1000))
        self.values = made[:256]
        self.base = int(made[256]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            most = max(n, 1 << 16)
            up, down = np.full(most, self.base, np.uint64), np.full(most, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self._up[:n], self._down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers(len(values) + 1)[0][:-1], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self._powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (len + 1 values)."""
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]
    finishes = np.zeros(len(data) + 1, bool)
    finishes[1:] = inside
    finishes[1:-1] &= ~inside[1:]
    finishes[edge[edge > 0]] = inside[edge[edge > 0] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
    return starts, ends, np.searchsorted(starts, offsets)
