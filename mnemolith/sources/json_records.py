"""Records of large JSON documents, read by ranges of bytes.

An export is one JSON document: an array of records, or an object that holds such
an array. Spark's text source can cut a file anywhere if lines end at ``{``, but what
a range means depends on whether it begins inside a string and how deeply.
Both are found without reading on: each range tells, for either beginning, how
its quotes and brackets change the state (a first pass, one row a range), and running sums over
a file's ranges compose these changes. A second pass cuts the records out, and those
that go on in later ranges are put together from their pieces. Memory is bounded by a
batch of pieces and the longest record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN = ord("{")
_sign = np.zeros(256, dtype=np.int64)
_sign[[ord("{"), ord("[")]] = 1
_sign[[ord("}"), ord("]")]] = -1
#: Where a record stands: whole in one range, begun in it, or going on from an earlier one.
WHOLE, BEGUN, REST = 0, 1, 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that come from one range of a file."""
    ends = {batch.num_rows}
    for name in ("file", "block"):
        ends.update(pc.run_end_encode(batch.column(name)).run_ends.to_pylist())
    start = 0
    for end in sorted(ends - {0}):
        part = batch.slice(start, end - start)
        yield (part.column("file")[0].as_py(), part.column("block")[0].as_py()), part
        start = end


def _bytes(pieces: pa.Array, from_start: bool) -> np.ndarray:
    """The pieces' bytes with the brace before each; a file's first piece has none."""
    pieces = pieces.cast(pa.large_binary())
    _, where, data = pieces.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return np.insert(data, offsets[from_start:-1] - offsets[0], OPEN)


def _brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and signs of brackets, the quotes before each modulo two, and all quotes modulo two.

    A quote counts unless an odd number of backslashes stands before it; data begin
    with a brace, so that none of these is cut off.
    """
    quotes = np.flatnonzero(data == ord('"'))
    backslash = data == ord("\\")
    if backslash.any() and len(quotes):
        last = np.maximum.accumulate(np.where(backslash, -1, np.arange(len(data))))
        before = np.maximum(quotes - 1, 0)
        quotes = quotes[(before - last[before]) % 2 == 0]
    sign = _sign[data]
    at = np.flatnonzero(sign)
    return at, sign[at], np.searchsorted(quotes, at) % 2, len(quotes) % 2


def _is_array(first: pa.RecordBatch) -> bool:
    """Whether the document that begins so is an array."""
    return first.column("piece")[0].as_py().lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"["


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: its quotes modulo two, its change of depth if it begins outside and inside of a string, and whether its document is an array."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        own = {"file": key[0], "block": key[1], **state}
        return pa.RecordBatch.from_pylist([own], pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("array", pa.bool_())]))

    for batch in batches:
        for own, part in _runs(batch):
            if own != key:
                if key is not None:
                    yield row()
                key, state = own, {"quotes": 0, "outside": 0, "inside": 0, "array": None}
                if own[1] == 0:
                    state["array"] = _is_array(part)
                    from_start = True
                else:
                    from_start = False
            else:
                from_start = False
            _, sign, quoted, quotes = _brackets(_bytes(part.column("piece"), from_start))
            change = [int(sign[quoted == 0].sum()), int(sign[quoted == 1].sum())]
            state["outside"] += change[state["quotes"]]
            state["inside"] += change[1 - state["quotes"]]
            state["quotes"] ^= quotes
    if key is not None:
        yield row()


def _cut(levels: tuple[int, int]):
    """Records that begin in each range, and the rests of those that began earlier; ``levels`` in objects and in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int32()), ("kind", pa.int32()), ("value", pa.binary())])
        key, quoted, depth, level, number, held = None, 0, 0, 0, 0, None
        out: list[dict] = []
        size = 0

        def add(kind: int, value: bytes) -> None:
            nonlocal size
            out.append({"file": key[0], "block": key[1], "number": number, "kind": kind, "value": value})
            size += len(value)

        for batch in batches:
            for own, part in _runs(batch):
                if own != key:
                    if held is not None:
                        add(held[0], b"".join(held[1]))
                    key, number = own, 0
                    from_start = own[1] == 0
                    if from_start:
                        quoted, depth, level = 0, 0, levels[_is_array(part)]
                    else:
                        quoted, depth, level = (part.column(name)[0].as_py() for name in ("quoted", "depth", "level"))
                    held = (REST, []) if depth > level else None
                else:
                    from_start = False
                data = _bytes(part.column("piece"), from_start)
                at, sign, parity, quotes = _brackets(data)
                real = (parity + quoted) % 2 == 0
                at, sign = at[real], sign[real]
                after = depth + np.cumsum(sign)
                begins, ends = at[(sign > 0) & (after == level + 1) & (data[at] == OPEN)], at[(sign < 0) & (after == level) & (data[at] == ord("}"))]
                begin, whole = 0, data.tobytes()
                if held is not None:
                    if len(ends) and (not len(begins) or ends[0] < begins[0]):
                        held[1].append(whole[: ends[0] + 1])
                        add(WHOLE if held[0] == BEGUN else REST, b"".join(held[1]))
                        number += held[0] == BEGUN
                        held, ends = None, ends[1:]
                    else:
                        held[1].append(whole)
                if held is None:
                    for begin, end in zip(begins, ends):  # the last one may not have ended
                        add(WHOLE, whole[begin : end + 1])
                        number += 1
                    if len(begins) > len(ends):
                        held = (BEGUN, [whole[begins[-1] :]])
                quoted ^= quotes
                depth += int(sign.sum())
            if size > 1 << 22 or len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if held is not None:
            add(held[0], b"".join(held[1]))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run

def json_records(spark: SparkSession, path: str | list[str], in_array: int = 1, in_object: int = 0) -> DataFrame:
    """``file, block, number, value``: the objects that stand so deep in each document, as text, in order of the first three columns.

    In a document that is an array the objects lie ``in_array`` brackets deep, in one
    that is an object ``in_object``: 0 is the document itself, 2 the elements of the
    arrays that it holds.
    """
    lines = spark.read.option("lineSep", "{").text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    cut_out, row = _cut((in_object, in_array)), "file string, block long, number int, kind int, value binary"
    text = F.col("value").cast("string").alias("value")
    # Files below the cost of opening one are never cut; the file list alone tells.
    large = F.col("_metadata.file_size") > spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    if lines.filter(large).isEmpty():
        return pieces.mapInArrow(cut_out, row).select("file", "block", "number", text)

    ranged = lines.filter(large).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    changes = ranged.mapInArrow(_changes, "file string, block long, quotes int, outside long, inside long, array boolean")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("quotes").over(earlier) % 2, F.lit(0)).cast("int")
    states = changes.withColumn("quoted", quoted).withColumn("change", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
    level = F.when(F.max("array").over(Window.partitionBy("file")), in_array).otherwise(in_object).cast("long")
    states = states.select("file", "block", "quoted", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"), level.alias("level"))
    # One row a range, some 100 bytes for each of 128 MB: broadcast, as a shuffle would break the pieces' order.
    cut = pieces.join(F.broadcast(states), ["file", "block"], "left").mapInArrow(cut_out, row)
    # The record that a range's rest belongs to began in the nearest range before it that left one open.
    so_far = Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("block", "number")
    parts = cut.filter(F.col("kind") != WHOLE).withColumn("of", F.last(F.when(F.col("kind") == BEGUN, place), ignorenulls=True).over(so_far))
    joined = parts.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", text))).alias("parts"))
    joined = joined.select("file", "of.block", "of.number", F.array_join("parts.value", "").alias("value"))
    return cut.filter(F.col("kind") == WHOLE).select("file", "block", "number", text).unionByName(joined)
