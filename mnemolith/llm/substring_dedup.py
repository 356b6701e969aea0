"""Removal of repeated passages.

A window is ``width`` consecutive words of one text. Every word that lies in a
window whose word sequence also starts somewhere else, in the same text or in
another, is removed; windows are judged on the input.

Method: Rabin-Karp hashes of all windows, counted by Spark. Counting 100 TB of
windows one row each would shuffle several times the corpus, so windows are
counted by runs, without loss:

* Each window has an anchor: the ``gram``-word sub-window with the least hash.
  Equal windows have equal anchors, so only windows of an anchor seen twice
  can repeat, and neighbouring windows share anchors, about one row for a
  dozen windows.
* A run is a stretch of windows with one anchor. A run whose words occur twice
  consists of repeated windows. The other runs of anchors seen twice (edges of
  passages, edited copies) are counted window by window.

Repeated windows merge into maximal intervals by text. Exact copies, however
many, give equal runs that Spark combines before the shuffle.

Equal runs have two equal 64-bit hashes, of the anchor and of all words, and equal
windows have two of all words.

Defined cases: null and empty texts have no words and keep the hash of the
empty string; texts under ``width`` words lose nothing; rows repeated as a
whole count as two texts; all places of a repeated window are removed, so there
are no ties; a null ``doc_id`` is kept; a text of any length is read whole, in one
task; further columns, whatever their names, are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written
from .tokens import Words, mix, rolling, span_hashes, text_slices, windows

_POSITION = 28  # bits for a word's place in a slice


def _anchor_runs(words: Words, hashes: np.ndarray, width: int, gram: int):
    """Anchor hash, run hash, first window, number of windows and text of each run."""
    start, text = windows(words, width)
    if not len(start):
        empty = np.zeros(0, dtype=np.uint64)
        return empty, empty, start, start, text
    grams = rolling(hashes, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    least = (grams >> np.uint64(_POSITION) << np.uint64(_POSITION)) | place
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:  # minimum over a sliding range, by doubling
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = (least[start] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(start)))
    first = start[head]
    return grams[at[head]], span_hashes(hashes, first, first + size - 1 + width), first, size, text[head]


def _runs(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            for row, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                anchor, whole, first, size, text = _anchor_runs(words, words.hashes(), width, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(key[row:end][text]),
                        pa.array((first - words.first[text]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    names=["anchor", "run", "key", "start", "size"],
                )

    return run


def _window_rows(width: int):
    """Hash of each window of the requested runs: ``asks`` lists ``(start, size, counted)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, asks = batch.column("key").to_numpy(), batch.column("asks")
            for row, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                part = asks.slice(row, end - row)
                flat = part.flatten()
                text = np.repeat(np.arange(end - row), np.diff(part.offsets.to_numpy()))
                start, size, weight = (flat.field(i).to_numpy() for i in range(3))
                of = np.repeat(np.arange(len(start)), size)
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                local = start[of] + within
                place = words.first[text[of]] + local
                hashes = words.hashes()
                hashed = span_hashes(hashes, place, place + width)
                again = span_hashes(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), place, place + width)  # tells apart windows that one hash takes for equal
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashed.view(np.int64)),
                        pa.array(again.view(np.int64)),
                        pa.array(key[row:end][text[of]]),
                        pa.array(local.astype(np.int32)),
                        pa.array(weight[of].astype(np.int64)),
                    ],
                    names=["window", "check", "key", "start", "weight"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each text's intervals and drop the words they cover."""
    for batch in batches:
        words, removed, digest, kept_text, spans = [], [], [], [], []
        texts, cuts = batch.column("text").cast(pa.large_binary()), batch.column("cuts")
        for text, cut in zip(texts, cuts, strict=True):
            parts = (text.as_py() or b"").split()
            merged: list[list[int]] = []
            for piece in sorted((c["start"], c["end"]) for c in (cut.as_py() or ())):
                if merged and piece[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], piece[1])
                else:
                    merged.append(list(piece))
            kept, at = [], 0
            for start, end in merged:
                kept += parts[at:start]
                at = end
            kept = kept + parts[at:] if merged else parts
            joined = b" ".join(kept)
            words.append(len(parts))
            removed.append(len(parts) - len(kept))
            digest.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(joined)
            spans.append([{"start": s, "end": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(words, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array(kept_text, pa.binary()).cast(pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"],
        )


def _of_repeated(rows: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the keys of ``repeated``, which has their counts ``n``.

    Keys with more than a ten-thousandth of all rows are at most ten thousand, so
    they are broadcast and their rows stay where they are; the others have too few
    rows to hold up a task.
    """
    total = repeated.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(total // 10_000, 1_000)
    hot = F.broadcast(repeated.filter(often).select(*keys))
    others = rows.join(hot, keys, "left_anti").join(repeated.filter(~often).select(*keys), keys)
    return rows.join(hot, keys).unionByName(others)


def remove_repeats(docs: DataFrame, width: int = 35, gram: int = 12) -> DataFrame:
    """Return ``doc_id, n_words, n_removed, kept_sha256, kept_text, removed_spans``.

    ``removed_spans`` are maximal word intervals, end exclusive; ``kept_text``
    joins the kept words by one space. ``gram`` is the length of the anchors
    that bundle windows for counting; it changes cost, not the result.
    """
    if not 1 <= gram <= width:
        raise ValueError("gram must lie between 1 and width")
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    base = base.withColumn("key", F.xxhash64("doc_id", "text"))
    runs = base.select("key", "text").mapInArrow(_runs(width, gram), "anchor long, run long, key long, start int, size int")

    # Written, as the tables below are, so that Spark can split what a frequent key brings to the other side.
    seen_twice = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    found = written(runs.join(seen_twice, "anchor"), "repeated-anchors")

    distinct_runs = found.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "size")).alias("one"))
    distinct_runs = written(distinct_runs, "runs")
    whole = _of_repeated(found, distinct_runs.filter("n > 1"), ["anchor", "run"])
    whole = whole.select("key", "start", (F.col("start") + F.col("size") - 1 + width).alias("end"))

    # A run seen once is asked for as itself; one copy of a repeated run stands for all in the counts.
    mixed = written(distinct_runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "mixed-anchors")
    asks = _of_repeated(distinct_runs, mixed, ["anchor"]).select("one.*", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"))
    asks = asks.groupBy("key").agg(F.collect_list(F.struct("start", "size", "weight")).alias("asks"))
    rows = base.join(asks, "key").select("key", "text", "asks").mapInArrow(_window_rows(width), "window long, check long, key long, start int, weight long")
    rows = written(rows, "edge-windows")
    again = written(rows.groupBy("window", "check").agg(F.sum("weight").alias("n")).filter("n > 1"), "repeated-windows")
    single = _of_repeated(rows, again, ["window", "check"]).select("key", "start", (F.col("start") + width).alias("end"))

    cuts = written(whole.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("cuts")), "cuts")
    discard(seen_twice, found, distinct_runs, mixed, rows, again)
    return (
        base.join(cuts, "key", "left")
        .select("doc_id", "text", "cuts")
        .mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans array<struct<start:int,end:int>>")
    )
