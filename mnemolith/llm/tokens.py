"""Vectorised word access to Arrow text columns.

All helpers work on one Arrow batch inside a Spark task. Texts are cut into
slices of about ``SLICE_BYTES`` so that memory stays bounded however many rows
a batch holds; one very long text forms a slice of its own. Null texts count
as empty. Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D, which
on UTF-8 equals the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8
WINDOW_BASE = 0xD1342543DE82EF95

_separator = np.zeros(256, dtype=bool)
_separator[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside terms of ASCII letters and characters beyond ASCII.
NO_LETTERS = np.zeros(256, dtype=bool)
NO_LETTERS[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (splitmix finaliser); a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(BASE), _Powers(WINDOW_BASE)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, end_row, bytes, offsets)`` of at most ``rows`` rows; offsets are relative to bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), row + rows, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Word boundaries of the texts of one slice.

    ``start`` and ``end`` are byte positions, ``first`` holds for each text the
    index of its first word (one more entry than texts), ``count`` its words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = _separator):
        self.data, self.offsets = (_lower[data] if lower else data), offsets
        inside = ~separator[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, from a polynomial prefix sum."""
        up, down = _byte_powers.upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_bytes[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` values, whatever text they cross."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _word_powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of the values of each span ``start:end``."""
    up, down = _word_powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each window's start and its text, windows never crossing texts."""
    per_text = np.maximum(words.count - width + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    within = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return words.first[text] + within, text
