"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (at most three bytes),
with PPM-C escape probabilities and frozen counts. A text's code length under a
language is the sum over its bytes of the bits for that byte after the longest
context that the tree holds; a context a language never saw, or a byte it never
saw there, costs the escape and goes on with the next shorter context. The
language with the shortest code wins; the score is its posterior under equal
priors.

The counts come from a bounded sample of labelled texts (an evenly hashed share
of ``max_texts`` texts for each language in expectation), counted by Spark. All
contexts of the sample are kept: of each order there is a table of the contexts
and a table of the context-and-byte pairs that any language has, with four bytes a
language in each row. Their size follows from the sample (about 2 MB for four
languages) and is broadcast. Scoring is one pass over whole texts without a
shuffle; a slice looks up each of its distinct byte quadruples once.

Defined cases: texts that are null or have no letter give ``und`` with score 0,
and so does everything if nothing is labelled; ties go to the language first in
code-point order; a null ``doc_id`` hashes as the empty string and a null
language is no label; repeated rows are scored one by one; a text of any length
is scored whole, in one task; extra columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .tokens import text_slices

ORDER = 3
SLICE = 4 << 20


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte after the three before it in its text, as one number; 0 stands before a text."""
    gram = data.astype(np.uint32)
    first = offsets[:-1][np.diff(offsets) > 0]
    size = np.diff(offsets)[np.diff(offsets) > 0]
    for back in range(1, ORDER + 1):
        earlier = np.zeros(len(data), dtype=np.uint32)
        earlier[back:] = data[: len(data) - back]
        for k in range(back):
            earlier[(first + k)[size > k]] = 0
        gram |= earlier << np.uint32(8 * back)
    return gram


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each context and byte, by language."""
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for row, end, data, offsets in text_slices(batch.column("text")):
            grams = _grams(data, offsets)
            names, which = np.unique(langs[row:end].astype(str), return_inverse=True)
            whose = np.repeat(which, np.diff(offsets))
            for k, name in enumerate(names):
                found, n = np.unique(grams[whose == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _tables(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each order the bits of known context-and-byte pairs and the bits of the escapes of known contexts."""
    tables, size = [], len(langs)
    for order in range(ORDER + 1):
        keys, row = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        counts = np.bincount(row * size + lang, n, len(keys) * size).reshape(-1, size)
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.zeros((2, len(contexts), size))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        escape = -np.log2(np.where(total > 0, kinds, 1) / np.where(total > 0, total + kinds, 1))  # none where a language lacks the context
        below = tables[-1]["bits"][np.searchsorted(tables[-1]["keys"], keys & ((1 << 8 * order) - 1))] if order else 8.0
        seen = counts > 0
        bits = np.where(seen, -np.log2(np.where(seen, counts, 1) / np.maximum(total + kinds, 1)[of]), escape[of] + below)
        tables.append({"keys": keys, "bits": bits, "contexts": contexts, "escape": escape})
    return [{"keys": t["keys"].astype(np.uint32), "bits": t["bits"].astype(np.float32), "contexts": t["contexts"].astype(np.uint32), "escape": t["escape"].astype(np.float32)} for t in tables]


def _found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted keys, and where."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    known = np.flatnonzero(keys[at] == values)
    return known, at[known]


def code_lengths(tables: list[dict[str, np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """Bits of each byte after its three predecessors, by language, in float32."""
    bits = np.full((len(grams), tables[0]["bits"].shape[1]), 8.0, dtype=np.float32)
    for order, table in enumerate(tables):
        own = grams & np.uint32((1 << 8 * (order + 1)) - 1)
        known, at = _found(table["contexts"], own >> np.uint32(8))
        bits[known] += table["escape"][at]
        known, at = _found(table["keys"], own)
        bits[known] = table["bits"][at]
    return bits


def train(labelled: DataFrame, max_texts: int = 2000) -> tuple[list[str], list[dict[str, np.ndarray]]]:
    """Learn from ``labelled(doc_id, text, lang)``; returns the languages and their tables."""
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.xxhash64("doc_id", F.lit("learn")).alias("draw"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    share = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(max_texts) / F.count("*")).alias("share"))
    sample = usable.join(F.broadcast(share), "lang").filter(F.pmod("draw", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = sample.select("text", "lang").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "byte-grams").toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return [], []
    number = {name: k for k, name in enumerate(langs)}
    lang = np.array([number[x] for x in counts.column("lang").to_pylist()])
    return langs, _tables(langs, lang, counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def _predicted(langs: list[str], model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE // max(1, len(langs) // 4)):
                texts, filled = end - row, np.flatnonzero(np.diff(offsets))
                cost = np.zeros((texts, max(1, len(langs))))
                if langs and len(filled):
                    grams, back = np.unique(_grams(data, offsets), return_inverse=True)
                    bits = code_lengths(tables, grams)
                    for k in range(len(langs)):
                        cost[filled, k] = np.add.reduceat(bits[back, k], offsets[filled], dtype=np.float64)
                best = cost.argmin(axis=1)
                ahead = cost - cost.min(axis=1, keepdims=True)
                score = 1 / np.exp2(-np.minimum(ahead, 1000)).sum(axis=1)
                sure = letters[row:end].astype(bool) & bool(langs)
                names = [langs[b] if s else "und" for b, s in zip(best, sure, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, texts), pa.array(names, pa.string()), pa.array(np.where(sure, score, 0.0)), pa.array(np.where(sure, cost.min(axis=1), 0.0))],
                    names=["doc_id", "lang_pred", "score", "code_bits"],
                )

    return run


def identify(docs: DataFrame, langs: list[str], tables: list[dict[str, np.ndarray]]) -> DataFrame:
    """Return ``doc_id, lang_pred, score, code_bits`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(tables)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return base.mapInArrow(_predicted(langs, model), "doc_id long, lang_pred string, score double, code_bits double")
