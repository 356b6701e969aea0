"""Source divergence audit: how far each source's terms are from its language's other sources.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A
language keeps the terms that occur in at least ``least`` of its documents. A
first pass over the texts makes count-min sketches of document frequencies, one a
task, merged block by block as they stream past; a counter never falls short of
a term's frequency (it stops at ``least``, beyond which nothing is asked), so that
a term with a counter below ``least`` is impossible. A second pass discards these
before anything is shuffled, and the others are counted exactly. The sketch has a
fixed size, ``DEPTH * WIDTH`` bytes at most where it is broadcast; a corpus of very many
terms fills it and loses only the saving.

Shares are integers, ``p = 1 + floor(10^9 * (count + 2) / (N + 2 V))``, and a term's
divergence is ``floor((p - q)^2 / (p + q))``. The sum over all kept terms needs none
of those that both sources lack: a pair's value is that of ``V`` such terms, plus a
correction for each source's own terms (added up by how often they occur), plus one for
each term that both have, found by a join on the term.

Defined cases: null text, language and source are empty; languages and sources
without kept terms still have their pairs, with value 0 where the language keeps
nothing; repeated rows count one by one; ties go by the item's UTF-8; texts of any length are
read whole; extra columns, whatever their names, are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, written
from .tokens import NO_LETTERS, Words, mix, span_hashes, text_slices

DEPTH, WIDTH, BLOCK = 4, 1 << 20, 1 << 14
SLICE = 1 << 20
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
SCALE = 1_000_000_000


def _salts(values: list[tuple]) -> np.ndarray:
    """A 64-bit hash of each tuple of strings."""
    return np.array([int.from_bytes(hashlib.blake2b("\0".join(v).encode(), digest_size=8).digest(), "little") for v in values], dtype=np.uint64)


def _codes(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[tuple]]:
    """Each row's number of its combination of values, and the combinations."""
    rows = list(zip(*[["" if v is None else v for v in batch.column(n).to_pylist()] for n in names], strict=True))
    numbers: dict[tuple, int] = {}
    return np.array([numbers.setdefault(r, len(numbers)) for r in rows], dtype=np.int64), list(numbers)


def _slots(keys: np.ndarray, row: int) -> np.ndarray:
    return (mix(keys ^ _SEEDS[row]) >> np.uint64(64 - 20)).astype(np.int64)


def _first_of_document(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of one word of each document's each term, whole keys compared."""
    order = np.lexsort((text, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(text[order]) != 0)
    return order[new]


def _sketched(least: int):
    """The task's sketch of (language, term) document frequencies, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((DEPTH, WIDTH), dtype=np.int64)
        waiting: list[np.ndarray] = []

        def counted() -> None:
            keys = np.concatenate(waiting)
            waiting.clear()
            for row in range(DEPTH):
                counters[row] += np.bincount(_slots(keys, row), minlength=WIDTH)
            np.minimum(counters, least, out=counters)

        for batch in batches:
            lang, langs = _codes(batch, "lang")
            salt = _salts(langs)
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE):
                words = Words(data, offsets, lower=True, separator=NO_LETTERS)
                text = words.text_of_word()
                keys = mix(words.hashes() ^ salt[lang[row:end][text]])
                waiting.append(keys[_first_of_document(text, keys)])
                if sum(map(len, waiting)) > 1 << 20:
                    counted()
        if waiting:
            counted()
        small = counters.astype(np.int32).reshape(-1, BLOCK)
        blocks = np.flatnonzero(small.any(axis=1))
        if len(blocks):
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([small[b].tobytes() for b in blocks], pa.binary())], names=["block", "counters"])

    return run


def _merged(least: int):
    """Sums of the counters of each block, whose rows stream past one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def row() -> pa.RecordBatch:
            possible = np.packbits(total >= least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([possible], pa.binary())], names=["block", "possible"])

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("block")[i].as_py()
                if own != block:
                    if block is not None:
                        yield row()
                    block, total = own, np.zeros(BLOCK, dtype=np.int64)
                total += np.frombuffer(batch.column("counters")[i].as_buffer(), dtype=np.int32)
                np.minimum(total, least, out=total)
        if block is not None:
            yield row()

    return run


def possible_terms(docs: DataFrame, least: int) -> np.ndarray:
    """For each counter of the merged sketch whether it reaches ``least``, as packed bits."""
    sketches = docs.select("lang", "text").mapInArrow(_sketched(least), "block int, counters binary")
    merged = sketches.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(least), "block int, possible binary")
    bits = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK // 8), dtype=np.uint8)
    for r in merged.collect():  # one row a block: DEPTH * WIDTH bits in all
        bits[r["block"]] = np.frombuffer(r["possible"], dtype=np.uint8)
    return bits.reshape(DEPTH, WIDTH // 8)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given byte spans as strings."""
    size = end - start
    offsets = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())])


def _counted(bits):
    """Occurrences and documents of the possible terms of each slice, by language and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        possible = [np.unpackbits(row).astype(bool) for row in bits.value]
        for batch in batches:
            group, groups = _codes(batch, "lang", "source")
            by_lang, by_group = _salts([g[:1] for g in groups]), _salts(groups)
            langs, sources = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE):
                words = Words(data, offsets, lower=True, separator=NO_LETTERS)
                text, term = words.text_of_word(), words.hashes()
                own = group[row:end][text]
                keys = mix(term ^ by_lang[own])
                met = np.ones(len(keys), dtype=bool)
                for r in range(DEPTH):
                    met &= possible[r][_slots(keys, r)]
                at = np.flatnonzero(met)
                if not len(at):
                    continue
                keys, text, own = mix(term[at] ^ by_group[own[at]]), text[at], own[at]
                # A second hash of the term's bytes tells apart what shares the first.
                other = span_hashes(words.data.astype(np.uint64) + np.uint64(1), words.start[at], words.end[at])
                order = np.lexsort((text, own, other, keys))
                keys, other, own, text = keys[order], other[order], own[order], text[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(keys) != 0) | (np.diff(other) != 0) | (np.diff(own) != 0)
                fresh = new.copy()
                fresh[1:] |= np.diff(text) != 0
                first = np.flatnonzero(new)
                sizes = np.diff(np.append(first, len(order)))
                documents = np.add.reduceat(fresh.astype(np.int64), first)
                where, code = at[order[first]], pa.array(own[first])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(code), sources.take(code), _strings(words.data, words.start[where], words.end[where]).cast(pa.string()), pa.array(sizes.astype(np.int64)), pa.array(documents)],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return run


def _share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 * (n + 2) / (total + 2 * kept))`` in decimals, as a long."""
    wide = "decimal(28,0)"
    over = (n.cast(wide) + 2) * F.lit(SCALE).cast("decimal(10,0)")
    # Of a quotient of whole numbers the whole part; `div` takes decimals.
    return F.lit(1).cast("long") + F.call_function("div", over.cast("decimal(38,0)"), (total.cast(wide) + kept.cast(wide) * 2).cast("decimal(38,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``.

    Part ``pair``: the language's other sources by their divergence from this one;
    part ``term``: the ``top`` terms that this source has more of than its language.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    bits = spark.sparkContext.broadcast(possible_terms(rows, least))
    some = rows.mapInArrow(_counted(bits), "lang string, source string, term string, n long, docs long")
    counts = written(some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    frequent = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= least).drop("docs")
    kept = written(counts.select("lang", "source", "term", "n").join(frequent, ["lang", "term"]), "kept-terms")
    discard(counts)
    bits.unpersist()

    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("all_lang"), F.count("*").alias("kept"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("all", "all_lang", "kept")])
    groups = groups.withColumn("none", F.when(F.col("kept") > 0, _share(F.lit(0), F.col("all"), F.col("kept"))))
    groups = written(groups, "groups")  # a row for each source of a language
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "none", _share(F.col("n"), F.col("all"), F.col("kept")).alias("p"), _share(F.col("n_lang"), F.col("all_lang"), F.col("kept")).alias("q")
    )
    shares = written(shares, "shares")
    discard(kept)

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    # Each source's own terms by how often they occur, against every other source that has none of them.
    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    own = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("terms"))
    lone = own.join(other, "lang").filter("source <> other")
    one_sided = (_apart(F.col("p"), F.col("other_none")) - _apart(F.col("none"), F.col("other_none"))) * F.col("terms")
    lone = lone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), one_sided.alias("value"))

    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("na"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("nb"))
    shared = left.join(right, ["lang", "term"]).filter("a < b")
    pa_, pb, na, nb = (F.col(c) for c in ("pa", "pb", "na", "nb"))
    both = shared.select("lang", "a", "b", (_apart(pa_, pb) - _apart(pa_, nb) - _apart(na, pb) + _apart(na, nb)).alias("value"))

    ends = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("na"), "kept")
    base = ends.join(groups.select("lang", F.col("source").alias("b"), F.col("none").alias("nb")), "lang").filter("a < b")
    base = base.select("lang", "a", "b", F.when(F.col("kept") > 0, _apart(na, nb) * F.col("kept")).otherwise(0).alias("value"))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (both, lone)]
    total = base.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = total.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
