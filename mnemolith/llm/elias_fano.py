"""Elias-Fano sequences and an n-gram trie whose levels are built from them.

All lookups take whole arrays, so one call serves a slice of text. The arrays
are packed in one block that readers map into memory.
"""

from __future__ import annotations

import json
import mmap

import numpy as np


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One block holding named arrays, each aligned to eight bytes."""
    head, body, at = {}, [], 0
    for name, value in arrays.items():
        raw = np.ascontiguousarray(value)
        head[name] = (at, raw.dtype.str, len(raw))
        body += [raw.tobytes(), bytes(-raw.nbytes % 8)]
        at += raw.nbytes + -raw.nbytes % 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def mapped(block: bytes) -> dict[str, np.ndarray]:
    """The arrays of a packed block, in one memory map that is no file."""
    memory = mmap.mmap(-1, len(block))
    memory.write(block)
    size = int.from_bytes(memory[:8], "little")
    head = json.loads(memory[8 : 8 + size])
    return {name: np.frombuffer(memory, dtype=kind, count=n, offset=8 + size + at) for name, (at, kind, n) in head.items()}


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Elias-Fano arrays of a non-decreasing sequence below ``universe``.

    ``upper`` is the unary code of the high parts in 64-bit words, ``ones``
    counts the set bits before each word, ``lower`` has the low parts.
    """
    values = values.astype(np.uint64)
    n = len(values)
    low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    size = n + (universe >> low_bits) + 2
    bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
    kind = np.uint8 if low_bits <= 8 else np.uint16 if low_bits <= 16 else np.uint32 if low_bits <= 32 else np.uint64
    return {"meta": np.array([n, low_bits, universe], dtype=np.int64), "upper": upper, "ones": ones, "lower": (values & np.uint64((1 << low_bits) - 1)).astype(kind)}


class EliasFano:
    """Reader of a sequence made by :func:`encode`."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.low_bits, self.universe = map(int, arrays[f"{prefix}meta"])
        self.upper, self.ones, self.lower = (arrays[f"{prefix}{name}"] for name in ("upper", "ones", "lower"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _select(self, ranks: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the set (or, flipped, clear) bit with each rank, from 0."""
        word = np.searchsorted(before, ranks, side="right") - 1
        left = (ranks - before[word]).astype(np.int64)
        bits = self.upper[word]
        bits = ~bits if flip else bits.copy()
        place = np.zeros(len(ranks), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the word that holds the bit
            count = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            over = left >= count
            left -= np.where(over, count, 0)
            place += np.where(over, width, 0)
            bits = np.where(over, bits >> np.uint64(width), bits)
        return word * 64 + place

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        high = self._select(index, self.ones, False) - index
        return (high << self.low_bits) | self.lower[index].astype(np.int64)

    def all(self) -> np.ndarray:
        """All values, from the set bits in one go."""
        high = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        return (high << self.low_bits) | self.lower.astype(np.int64)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first element that is not below each value, and whether it equals the value."""
        high = values >> self.low_bits
        low = values & ((1 << self.low_bits) - 1)
        start = np.zeros(len(values), dtype=np.int64)
        inner = high > 0
        start[inner] = self._select(high[inner] - 1, self.zeros, True) - (high[inner] - 1)
        end = self._select(high, self.zeros, True) - high
        last = end.copy()
        open_ = np.flatnonzero(start < end)
        while len(open_):  # by halves of the elements of one high part, which ascend
            middle = (start[open_] + end[open_]) >> 1
            over = self.lower[middle] < low[open_]
            start[open_[over]] = middle[over] + 1
            end[open_[~over]] = middle[~over]
            open_ = open_[start[open_] < end[open_]]
        equal = start < last
        equal[equal] = self.lower[start[equal]] == low[equal]
        return start, equal

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Position of the first element that is not below each value (``n`` if none)."""
        return self._search(values)[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, or -1."""
        if not self.n or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        at, equal = self._search(values)
        return np.where(equal, at, -1)


STEPS = 1 << 12  # codes of logarithms to one unit; two bytes reach down to 1e-16


def units(values: np.ndarray) -> np.ndarray:
    """Two-byte codes of probabilities: negated base-10 logarithms in steps of ``1 / STEPS``."""
    return np.clip(np.rint(np.log10(values) * -STEPS), 0, 0xFFFF).astype(np.uint16)


WIDE = 32  # bits of a word's code


def build(lower: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, triples: np.ndarray, p2: np.ndarray, p3: np.ndarray, back2: np.ndarray, back3: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a :class:`Trie`.

    ``lower`` are codes of lower contexts. ``pairs`` and ``contexts`` are a lower
    context's number and, above and below it, a word's code: the word after it and
    the word before it. ``triples`` are a context's number and the word after it.
    All ascend.
    """
    arrays = {f"lower.{k}": v for k, v in encode(lower, 1 << WIDE).items()}
    for name, children, parents in (("pairs", pairs, len(lower)), ("contexts", contexts, len(lower)), ("triples", triples, len(contexts))):
        pointer = np.searchsorted(children >> np.uint64(WIDE), np.arange(parents + 1, dtype=np.uint64))
        arrays |= {f"{name}.{k}": v for k, v in encode(pointer, len(children) + 1).items()}
        arrays[f"{name}.words"] = (children & np.uint64((1 << WIDE) - 1)).astype(np.uint32)
    for name, values in (("p2", p2), ("p3", p3), ("back2", back2), ("back3", back3)):
        arrays[f"{name}.codes"] = units(values)
    return arrays


class _Level:
    """Children of numbered parents: their words ascend within a parent, and monotone pointers say where each parent's begin."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.pointer, self.words = EliasFano(arrays, f"{name}."), arrays[f"{name}.words"]

    def ranges(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and end of the children of each parent."""
        if len(parents) * 8 > self.pointer.n:  # most parents are asked for
            pointer = self.pointer.all()
            return pointer[parents], pointer[parents + 1]
        return self.pointer[parents], self.pointer[parents + 1]

    def find(self, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Number of the child with each word within ``start:end``, or -1: a successor search relative to the parent."""
        at, last = start.copy(), end.copy()
        open_ = np.flatnonzero(at < last)
        while len(open_):
            middle = (at[open_] + last[open_]) >> 1
            below = self.words[middle] < words[open_]
            at[open_[below]] = middle[below] + 1
            last[open_[~below]] = middle[~below]
            open_ = open_[at[open_] < last[open_]]
        equal = at < end
        equal[equal] = self.words[at[equal]] == words[equal]
        return np.where(equal, at, -1)


class Trie:
    """An n-gram trie, queried by arrays of tokens.

    Probabilities and backoff weights are the codes of :func:`units`.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.lower = EliasFano(arrays, "lower.")
        self.pairs, self.contexts, self.triples = (_Level(arrays, name) for name in ("pairs", "contexts", "triples"))
        self.codes = {name: arrays[f"{name}.codes"] for name in ("p2", "p3", "back2", "back3")}

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.codes[name][at].astype(np.int64)

    def score(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """Code of the smoothed probability of each ``w`` after ``v`` and, before that, ``u``; ``unigram`` are those of ``w`` alone."""
        out = unigram.copy()
        some, back = np.unique(v, return_inverse=True)
        node = self.lower.find(some.astype(np.int64))[back]
        at = np.flatnonzero(node >= 0)
        if not len(at):
            return out
        node, w = node[at], w[at]
        # Ranges of children are looked up once for each distinct parent.
        some, back = np.unique(node << WIDE | u[at], return_inverse=True)
        parent = some >> WIDE
        context = self.contexts.find(*self.contexts.ranges(parent), (some & ((1 << WIDE) - 1)).astype(np.uint32))
        start, end = np.zeros((2, len(some)), dtype=np.int64)
        known = context >= 0
        start[known], end[known] = self.triples.ranges(context[known])
        triple = self.triples.find(start[back], end[back], w)
        value = np.empty(len(at), dtype=np.int64)
        full = triple >= 0
        value[full] = self._value("p3", triple[full])
        rest = np.flatnonzero(~full)
        if len(rest):
            pair = self.pairs.find(*self.pairs.ranges(node[rest]), w[rest])
            seen = pair >= 0
            lower = self._value("back2", node[rest]) + unigram[at[rest]]
            lower[seen] = self._value("p2", pair[seen])
            over = context[back[rest]]
            # Without any context there are no weights to look up.
            after = over >= 0
            lower[after] += self._value("back3", over[after])
            value[rest] = lower
        out[at] = value
        return out
