"""Benchmark decontamination under edit distance.

A text is contaminated by an item if some stretch of it turns into the item's
words with at most ``max_edits`` of the item's number of words in edits (word
insertions, deletions, replacements; A-Z in lower case). Items of fewer than
``exact_below`` words must occur unchanged, as a fifth of fewer than five words is no edit.

Method. The CGK random walk reads a window with a pointer that advances or stays
after each step, by a random bit of the step and the word under it. Two windows
within a small edit distance meet again after an edit, so edit distance becomes
Hamming distance between walks. A key is a sample of ``SAMPLED`` steps of a walk
(bit sampling), and every repeat has its own bits and sample.

* Items are put into classes by length. A class has windows of its least item's
  length, walks of three steps for two words, samples over the whole walk, and
  as many repeats as reach ``recall`` on drawn items with all edits allowed. Past
  the end of its window a walk reads padding.
* An item's windows start at several of its words in its first half, so that an
  edit at its beginning does not decide alone; a text's start at every word that
  can lie in a match at all: a match with k edits keeps all but 2 k of the item's
  pairs of neighbouring words, so starts near too few pairs that any item of the
  class has are passed over, without loss.
* A key that an item's and a text's window share proposes a place, and every
  proposal is verified exactly, by edit distance of the item to all stretches
  of the text there.

Items are the query set, in blocks of ``block`` items: the keys of one block are
broadcast, so their size is bounded, and all texts are read once for a block,
without a shuffle.

Defined cases: null and empty texts match nothing; null items and items without
a word are not searched; repeated items are searched once under the least
``item_id``; repeated rows are matched one by one; of stretches with equally few
edits that which ends first is given, and of these the shortest; a text of any
length is read whole, in one task; extra columns, whatever their names, are kept
by :func:`uncontaminated` and otherwise ignored; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import HashIndex
from .tokens import Words, mix, rolling, text_slices

SAMPLED = 3
MOST_STEPS = 128  # two 64-bit words of random bits
MOST_REPEATS = 24
OFFSETS = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64]
SLICE = 1 << 20
AT_ONCE = 1 << 15  # windows walked together


def _samples(width: int, repeats: int) -> np.ndarray:
    """Which steps each repeat's key looks at; the first step is always one."""
    steps = min(max(1, 3 * width // 2), MOST_STEPS)
    chance = np.random.default_rng(7)
    chosen = np.zeros((steps, repeats), dtype=bool)
    chosen[0] = True
    for repeat in range(repeats):
        chosen[chance.choice(np.arange(1, steps), min(SAMPLED, steps) - 1, replace=False), repeat] = True
    return chosen


def _walk_keys(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Keys ``(repeat, window)`` of the windows of ``words`` that begin and end there."""
    steps, repeats = samples.shape
    seeds = mix(np.arange(1, repeats + 1, dtype=np.uint64))[:, None]
    bits = [mix(words[None, :] ^ seeds)]
    if steps > 64:
        bits.append(mix(bits[0] ^ np.uint64(0xA5A5)))
    bits = [b.reshape(-1) for b in bits]
    row = (np.arange(repeats) * len(words))[:, None]
    pointer = np.repeat(starts[None, :].astype(np.int64), repeats, axis=0)
    key = np.repeat(seeds, len(starts), axis=1)
    last = len(words) - 1
    for step in range(int(np.flatnonzero(samples.any(axis=1))[-1]) + 1):
        here = np.minimum(pointer, last)
        asked = np.flatnonzero(samples[step])
        if len(asked):
            read = np.where(pointer[asked] < stops, words[here[asked]], np.uint64(0))
            key[asked] = mix(key[asked] * np.uint64(0x9E3779B97F4A7C15) + read)
        pointer += (bits[step // 64][row + here] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64)
    return key


def _offsets(length: int) -> np.ndarray:
    """Words of an item at which its windows start."""
    return np.array([o for o in OFFSETS if o <= length // 2 and o < length])


@lru_cache(maxsize=256)
def repeats_for(width: int, length: int, edits: int, recall: float, trials: int = 150) -> int:
    """Least repeats that find at least ``recall`` of drawn items of ``length`` words with ``edits`` edits.

    Each drawn item gives the share of walks that meet, and so its chance to be missed by all.
    """
    if not edits:
        return 1  # equal windows have equal keys
    chance = np.random.default_rng(length)
    samples = _samples(width, MOST_REPEATS)
    met = np.zeros(trials)
    for trial in range(trials):
        item = chance.integers(1, 1 << 62, length)
        text = item.tolist()
        for _ in range(edits):
            at, kind, new = int(chance.integers(len(text))), chance.integers(3), int(chance.integers(1, 1 << 62))
            text[at : at + 1] = ([new], [], [text[at], new])[kind]
        text = np.concatenate([text, chance.integers(1, 1 << 62, length)]).astype(np.uint64)
        item, offsets, starts = item.astype(np.uint64), _offsets(length), np.arange(len(text) - length)
        own = _walk_keys(item, offsets, np.minimum(offsets + width, length), samples)
        other = _walk_keys(text, starts, np.minimum(starts + width, len(text)), samples)
        met[trial] = np.mean([np.isin(own[r], other[r]).any() for r in range(MOST_REPEATS)])
    enough = [r for r in range(1, MOST_REPEATS) if np.mean((1 - met) ** r) <= 1 - recall]
    return min(enough, default=MOST_REPEATS)


def _edits(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edits that turn ``item`` into a stretch of each window row, by the stretch's end."""
    columns = np.arange(windows.shape[1] + 1)
    row = np.zeros((len(windows), windows.shape[1] + 1), dtype=np.int32)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - columns, axis=1) + columns  # insertions
    return row


def _length_class(length: int, exact_below: int) -> int:
    """Least length of the class: the next power of two or one and a half of it below."""
    if length < exact_below:
        return length
    power = 1 << (length.bit_length() - 1)
    return max(exact_below, power * 3 // 2 if length >= power * 3 // 2 else power)


class _Class:
    """Window keys of the items of one length class."""

    def __init__(self, width: int, numbers: list[int], words: list[np.ndarray], allowed: list[int], recall: float):
        lengths = [len(words[k]) for k in numbers]
        self.width = width
        self.longest = max(len(words[k]) + allowed[k] for k in numbers)
        self.pairs = min(len(words[k]) - 1 - 2 * allowed[k] for k in numbers)
        ends = {(len(words[k]), allowed[k]) for k in (min(numbers, key=lambda k: len(words[k])), max(numbers, key=lambda k: len(words[k])))}
        repeats = max(repeats_for(width, n, e, recall) for n, e in ends)
        self.samples = _samples(width, repeats)
        self.reach = int(_offsets(max(lengths))[-1]) + max(allowed[k] for k in numbers)
        keys, item, offset = [], [], []
        for k in numbers:
            starts = _offsets(len(words[k]))
            found = _walk_keys(words[k], starts, np.minimum(starts + width, len(words[k])), self.samples)
            keys.append(found.reshape(-1))
            item.append(np.full(found.size, k, dtype=np.int32))
            offset.append(np.tile(starts.astype(np.int32), repeats))
        keys, item, offset = map(np.concatenate, (keys, item, offset))
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int64)
        self.item, self.offset = item[order], offset[order]

    def starts(self, known: np.ndarray) -> np.ndarray:
        """Words near enough pairs that some item of the class has; ``known`` marks those pairs."""
        if self.pairs <= 0:
            return np.arange(len(known))
        total = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
        if total[-1] < self.pairs:
            return np.zeros(0, dtype=np.int64)
        ends = np.minimum(np.arange(len(known)) + self.longest - 1, len(known))
        full = np.concatenate([[0], np.cumsum(total[ends] - total[:-1] >= self.pairs, dtype=np.int32)])
        at = np.arange(len(known))
        return np.flatnonzero(full[at + 1] > full[np.maximum(at - self.reach, 0)])

    def proposals(self, hashes: np.ndarray, stop: np.ndarray, known: np.ndarray, index: HashIndex) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item numbers, a word of the text and the word where the item would start."""
        starts = self.starts(known)
        for part in np.array_split(starts, -(-len(starts) // AT_ONCE)) if len(starts) else []:
            # Only words that a window can read are looked at; neighbours stay neighbours.
            read = np.zeros(len(hashes) + 1, dtype=np.int32)
            np.add.at(read, part, 1)
            np.add.at(read, np.minimum(part + self.width, len(hashes)), -1)
            seen = np.flatnonzero(np.cumsum(read[:-1]) > 0)
            place = np.searchsorted(seen, part)
            key = _walk_keys(hashes[seen], place, place + np.minimum(self.width, stop[part] - part), self.samples)
            at = index.find(key.reshape(-1))
            hit = np.flatnonzero(at >= 0)
            low, high = self.first[at[hit]], self.first[at[hit] + 1]
            of = np.repeat(np.arange(len(hit)), high - low)
            entry = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            window = part[hit[of] % len(part)]
            yield self.item[entry], window, window - self.offset[entry]


class _Items:
    """Keys of one block of items."""

    def __init__(self, rows: list[tuple[int, str]], max_edits: float, recall: float, exact_below: int):
        texts = pa.array([text for _, text in rows], pa.string())
        self.ids, self.words = [], []
        seen = set()
        for start, end, data, offsets in text_slices(texts):
            words = Words(data, offsets, lower=True)
            hashes = words.hashes()
            for k in range(end - start):
                own = hashes[words.first[k] : words.first[k + 1]]
                if len(own) and own.tobytes() not in seen:
                    seen.add(own.tobytes())
                    self.ids.append(rows[start + k][0])
                    self.words.append(own)
        self.allowed = [int(max_edits * len(w)) if len(w) >= exact_below else 0 for w in self.words]
        of_class: dict[int, list[int]] = {}
        for k, own in enumerate(self.words):
            of_class.setdefault(_length_class(len(own), exact_below), []).append(k)
        self.classes = [_Class(width, numbers, self.words, self.allowed, recall) for width, numbers in sorted(of_class.items())]
        # One bit of each class by the leading bits of a pair's hash: a pair may pass by chance, none is missed.
        pairs = sum(max(len(w) - 1, 0) for w in self.words)
        self.shift = np.uint64(64 - max(16, (16 * pairs).bit_length()))
        self.known = np.zeros(1 << (64 - int(self.shift)), dtype=np.uint64)
        for c, (_, numbers) in enumerate(sorted(of_class.items())):
            for k in numbers:
                self.known[(rolling(self.words[k], 2) >> self.shift).astype(np.int64)] |= np.uint64(1 << c % 64)

    def indexes(self) -> list[HashIndex]:
        return [HashIndex(c.keys) for c in self.classes]

    def matches(self, words: Words, indexes: list[HashIndex]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item number, first word, words, edits)``: the best stretch of each text and item."""
        hashes = words.hashes()
        if not len(hashes) or not self.ids:
            return []
        text = words.text_of_word()
        stop = words.first[1:][text]
        classes = np.zeros(len(hashes), dtype=np.uint64)
        classes[:-1] = self.known[(rolling(hashes, 2) >> self.shift).astype(np.int64)]
        classes[stop - 1] = 0  # no pair across two texts
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for c, (some, index) in enumerate(zip(self.classes, indexes, strict=True)):
            for item, window, start in some.proposals(hashes, stop, classes >> np.uint64(c % 64) & np.uint64(1), index):
                self._verify(hashes, words.first, item, text[window], start, best)
        return [self._stretch(hashes, words.first, t, k, *found) for (t, k), found in sorted(best.items())]

    def _verify(self, hashes: np.ndarray, first: np.ndarray, item: np.ndarray, text: np.ndarray, start: np.ndarray, best: dict) -> None:
        """Put the edits and end of each text's best stretch for an item into ``best``."""
        if not len(item):
            return
        step = np.array(self.allowed)[item] + 1  # places within the allowed edits are verified as one
        proposed = np.unique(np.stack([item, text, start // step * step], axis=1), axis=0)
        numbers, heads = np.unique(proposed[:, 0], return_index=True)
        for k, rows in zip(numbers.tolist(), np.split(proposed, heads[1:]), strict=True):
            own, most, t, begin = self.words[k], self.allowed[k], rows[:, 1], rows[:, 2]
            begin = np.clip(begin - most, first[t], first[t + 1])
            spots = begin[:, None] + np.arange(len(own) + 3 * most + 1)
            grid = np.where(spots < first[t + 1][:, None], hashes[np.minimum(spots, len(hashes) - 1)], np.uint64(0))
            likely = np.flatnonzero(np.isin(grid, own).sum(axis=1) >= len(own) - most)  # too few known words cannot match
            for part in np.array_split(likely, -(-len(likely) // 4096)) if len(likely) else []:
                edits = _edits(own, grid[part])
                ends = edits.argmin(axis=1)
                for e, n, at, b in zip(edits.min(axis=1).tolist(), ends.tolist(), t[part].tolist(), begin[part].tolist(), strict=True):
                    if e <= most and (e, b + n) < best.get((at, k), (1 << 60, 0)):
                        best[at, k] = (e, b + n)

    def _stretch(self, hashes: np.ndarray, first: np.ndarray, t: int, k: int, edits: int, end: int) -> tuple[int, int, int, int, int]:
        """The shortest stretch that ends there with so many edits, from the item read backwards."""
        own = self.words[k]
        back = hashes[max(first[t], end - len(own) - edits) : end][::-1]
        row = np.arange(len(back) + 1)
        for i, word in enumerate(own[::-1], 1):
            new = np.concatenate([[i], np.minimum(row[:-1] + (back != word), row[1:] + 1)])
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        size = int(np.flatnonzero(row == edits)[0])
        return t, k, int(end - size - first[t]), size, edits


def _found(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = model.value
        indexes = items.indexes()
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE):
                rows = items.matches(Words(data, offsets, lower=True), indexes)
                text, item, start, n, edits = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
                ids = pa.array(items.ids, pa.int64()).take(pa.array(item))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row).take(pa.array(text)), ids, pa.array(start), pa.array(n), pa.array(edits)],
                    names=["doc_id", "item_id", "start_word", "n_words", "edits"],
                )

    return run


def _clean(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = model.value
        indexes = items.indexes()
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for row, _, data, offsets in text_slices(batch.column("text"), SLICE):
                for match in items.matches(Words(data, offsets, lower=True), indexes):
                    keep[row + match[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(items: DataFrame, max_edits: float, recall: float, exact_below: int, block: int) -> Iterator:
    usable = items.filter("text IS NOT NULL").groupBy(F.col("text").cast("string").alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    spark = items.sparkSession
    blocks = max(1, -(-usable.count() // block))
    parts = usable.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    for k in range(blocks):
        rows = sorted((r["item_id"] is None, r["item_id"], r["text"]) for r in parts.filter(F.col("block") == k).collect())
        yield spark.sparkContext.broadcast(_Items([(item, text) for _, item, text in rows], max_edits, recall, exact_below))


def contamination(docs: DataFrame, items: DataFrame, max_edits: float = 0.2, recall: float = 0.999, exact_below: int = 5, block: int = 10_000) -> DataFrame:
    """Return ``doc_id, item_id, start_word, n_words, edits``: the best match of each text and item."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for model in _blocks(items, max_edits, recall, exact_below, block):
        one = base.mapInArrow(_found(model), "doc_id long, item_id long, start_word long, n_words long, edits long")
        found = one if found is None else found.unionByName(one)
    return found


def uncontaminated(docs: DataFrame, items: DataFrame, max_edits: float = 0.2, recall: float = 0.999, exact_below: int = 5, block: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    for model in _blocks(items, max_edits, recall, exact_below, block):
        docs = docs.mapInArrow(_clean(model), docs.schema)
    return docs
