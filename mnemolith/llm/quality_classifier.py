"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text is described by terms: its words, the shapes of its words (which kinds of
characters they hold, and how long they are), the shapes of neighbours, and
repeats of words and of pairs, each hashed to one of ``FEATURES`` columns. Counts are damped and
weighted by how few labelled texts have the term; the leading singular vectors of
the labelled texts make the latent space. A document's score is the share of
label 1 among its nearest labelled vectors, each weighing by a power of its cosine. The
cosines of a document with all labelled vectors are computed, in blocks of documents by one matrix
product each, so that the neighbours are exact.

The labelled texts are an evenly hashed sample of ``max_labelled`` in expectation.
They are described in Spark's tasks; the driver gets at most ``FEATURES`` counts
of each, and what is broadcast has ``max_labelled * dimensions + FEATURES * dimensions`` numbers
(3 MB). Scoring is one pass over whole texts, without a shuffle.

Defined cases: null texts are empty; a text without words, and every text where a
label of one kind is missing, scores the share of label 1 among the labelled (0.5
without any). Null labels and labels without a document are no labels; several
labels of a document count each. Ties among neighbours do not matter, as equal cosines beyond the
last place weigh with the others. Repeated rows are scored one by one, to the same score; a text
of any length is described whole, in one task; extra columns, whatever their names,
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written
from .tokens import Words, mix, text_slices

FEATURES = 4096
BLOCK = 256
SLICE = 1 << 20
#: Kinds of bytes: lower, upper, digit, sentence mark, exclamation mark, symbol, beyond ASCII.
_kinds = np.zeros(256, dtype=np.uint8)
for _bit, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:?'\"()-", b"!", b"#*$%&|<>@=+~^_/\\{}[]`", range(128, 256))):
    _kinds[list(_bytes)] = 1 << _bit
_WORD, _SHAPE, _SHAPES, _REPEAT, _PAIR = (np.uint64(x * 0x9E3779B97F4A7C15 % (1 << 64)) for x in range(1, 6))


def _column(values: np.ndarray, family: np.uint64) -> np.ndarray:
    return (mix(values ^ family) % np.uint64(FEATURES)).astype(np.int64)


def _seen_before(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places whose value occurred earlier in the same text."""
    order = np.lexsort((np.arange(len(values)), values, text))
    again = np.zeros(len(values), dtype=bool)
    again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (values[order[1:]] == values[order[:-1]])
    return np.flatnonzero(again)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, column)`` of every term of a slice."""
    plain = Words(data, offsets)
    if not len(plain.start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text, size = plain.text_of_word(), plain.end - plain.start
    word = Words(data, offsets, lower=True).hashes()
    edges = np.column_stack([plain.start, plain.end]).ravel()
    kinds = np.bitwise_or.reduceat(np.append(_kinds[data], np.uint8(0)), edges)[::2]
    shape = kinds.astype(np.uint64) * np.uint64(8) + np.minimum(size // 3, 7).astype(np.uint64)
    next_in_text = np.flatnonzero(text[1:] == text[:-1])
    pair = mix(word[:-1] + np.uint64(3) * word[1:])[next_in_text]
    shapes = (shape[:-1] * np.uint64(1024) + shape[1:])[next_in_text]
    near = [np.flatnonzero((text[back:] == text[:-back]) & (word[back:] == word[:-back])) + back for back in (1, 2)]
    again = _seen_before(text[next_in_text], pair)
    parts = [
        (text, _column(word, _WORD)),
        (text, _column(shape, _SHAPE)),
        (text[next_in_text], _column(shapes, _SHAPES)),
        *[(text[at], np.full(len(at), _column(np.array([back], dtype=np.uint64), _REPEAT)[0])) for back, at in enumerate(near)],
        (text[next_in_text[again]], np.full(len(again), _column(np.zeros(1, dtype=np.uint64), _PAIR)[0])),
    ]
    return np.concatenate([t for t, _ in parts]), np.concatenate([c for _, c in parts])


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of terms of at most ``BLOCK`` texts at a time."""
    for row, end, data, offsets in text_slices(column, SLICE, BLOCK):
        text, at = _terms(data, offsets)
        yield row, end, np.bincount(text * FEATURES + at, minlength=(end - row) * FEATURES).reshape(end - row, FEATURES)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, counts in _blocks(batch.column("text")):
            columns = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").slice(row, end - row),
                    batch.column("quality").slice(row, end - row),
                    pa.array([x.astype(np.int16) for x in columns], pa.list_(pa.int16())),
                    pa.array([np.minimum(c[x], 1 << 30).astype(np.int32) for c, x in zip(counts, columns, strict=True)], pa.list_(pa.int32())),
                ],
                names=["key", "quality", "at", "n"],
            )


def _leading(damped: np.ndarray, rarity: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The map of damped counts to the latent space: the leading right singular vectors of weighted texts of length one, by subspace iteration from a fixed start."""
    rows = damped * rarity
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    basis = np.random.default_rng(5).standard_normal((rows.shape[1], min(dimensions + 16, *rows.shape))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dimensions] * rarity[:, None], dtype=np.float32)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, dimensions: int = 64, neighbours: int = 40, power: float = 8.0) -> dict:
    """Learn from ``docs(doc_id, text)`` with ``labels(doc_id, quality)``."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, max_labelled / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("neighbours")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The sample's identifiers are bounded by max_labelled; the texts stay where they are.
    described = texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("key"), "text", "quality").mapInArrow(_described, "key long, quality int, at array<smallint>, n array<int>")
    sample = written(described, "described")
    found = sample.toArrow().combine_chunks()
    discard(sample)
    good = found.column("quality").to_numpy() == 1
    prior = float(good.mean()) if len(good) else 0.5
    if prior in (0, 1) or not len(good):
        return {"prior": prior, "vectors": None}
    # A fixed order, whatever order the tasks came in.
    order = np.lexsort((good, found.column("key").to_numpy()))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    at, n = found.column("at").chunk(0), found.column("n").chunk(0)
    damped = np.zeros((len(order), FEATURES), dtype=np.float32)
    damped[np.repeat(place, np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = np.log1p(n.flatten().to_numpy())
    del found, at, n
    rarity = np.log((1 + len(damped)) / (1 + np.count_nonzero(damped, axis=0))).astype(np.float32) + np.float32(0.1)
    space = _leading(damped, rarity, dimensions)
    vectors = damped @ space
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return {"prior": prior, "space": space, "vectors": vectors.astype(np.float32), "quality": good[order].astype(np.float32), "neighbours": min(neighbours, len(order)), "power": power}


def _votes(near: np.ndarray, model: dict) -> np.ndarray:
    """Shares of label 1 among the nearest, by the cosines of a block of documents with all labelled ones."""
    last = np.partition(near, near.shape[1] - model["neighbours"], axis=1)[:, [near.shape[1] - model["neighbours"]]]
    weight = np.where(near >= last, np.maximum(near, 0), 0).astype(np.float64) ** model["power"]
    # One vote of the whole sample's share, so that far neighbours decide little.
    return (weight @ model["quality"] + model["prior"] * 0.05) / (weight.sum(axis=1) + 0.05)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model["vectors"] is None:
                score = np.full(batch.num_rows, model["prior"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
                continue
            for row, end, counts in _blocks(batch.column("text")):
                vectors = np.log1p(counts).astype(np.float32) @ model["space"]
                size = np.linalg.norm(vectors, axis=1)
                score = _votes(vectors / np.maximum(size, 1e-12)[:, None] @ model["vectors"].T, model)
                score = np.where(size > 0, np.clip(score, 0, 1), model["prior"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(score)], names=["doc_id", "score"])

    return run


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """Return ``doc_id, score`` for every row of ``docs``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
