"""Scoring texts by a word trigram model held in an Elias-Fano trie.

Model. Interpolated absolute discounting: a trigram's probability backs off to
the bigram's and that to the word's. Every trigram, bigram and word of the
training texts counts; nothing is pruned. Words that are not among the
``max_frequent`` most frequent, seen or not, share one unigram probability; their
bigrams and trigrams are their own. Probabilities after any context sum to one
over all words, the text's end and one word for all unseen ones.

Trie. The n-grams are dealt into buckets by their middle word, so that a
trigram, its context, its bigram and the context of that lie in one bucket of
about ``bucket`` tokens. A word with more occurrences than that is split: the
word before it draws the bucket, and after a pair of words that alone fills two
buckets the text and the place do. What a bucket cannot count alone, the bigrams
of split words and the trigrams of such pairs, is summed over all buckets and
given back to those that hold them, so that ``bucket`` changes no score: a word's pairs
are dealt into as many pieces as its occurrences fill four buckets, and a bucket sends each
piece that it has of them as arrays. Each
bucket builds its part of the trie in one task: contexts, bigrams and trigrams are
Elias-Fano sequences in which a child is found by a successor search relative to
its context, with pointers to the first child, and probabilities and backoff
weights are two-byte codes of logarithms, the same everywhere, whose sums are whole
numbers. The part scores all tokens of the bucket and is gone with the task; what
is gathered grows with the corpus, and no task holds more than about a bucket.

Texts are read once for their words' counts and once as slices. A slice sends
each bucket the tokens that it has of it as arrays, and gets back one sum for
each of its texts. Counts of the ``max_frequent`` most frequent words are broadcast;
all others are rows of the text that join the full table of counts.

Defined cases: null and empty texts score their end alone; a null ``doc_id``
hashes as the empty string and so trains; rows repeated as a whole are scored
one by one and count repeatedly; frequent words, by all texts, tie by their hash; a
text of any length is read whole, in one slice; extra columns, whatever their names, are
ignored; an empty table gives no rows; without training texts all counts are
zero and every token has the same probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import STEPS, Trie, build, mapped, pack, units
from .lookup import HashIndex
from .storage import written
from .tokens import Words, mix, text_slices

END_WORD = int(mix(np.array([0x454E44], dtype=np.uint64)).view(np.int64)[0])
COMMON = 1 << 19  # codes below are ranks of frequent words
END = (1 << 32) - 1  # code of a text's end, which also stands before its start
SLICE = 1 << 20
SLICE_ROWS = 1 << 14
PIECE = 4  # buckets whose tokens' pairs are summed in one piece, at most


def held_out(doc_id: F.Column, parts: int, part: int) -> F.Column:
    """Whether crc32 of the identifier as text leaves ``part`` modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        learn = batch.column("learn").to_numpy(zero_copy_only=False)
        for row, end, data, offsets in text_slices(batch.column("text"), SLICE):
            words = Words(data, offsets, lower=True)
            found, of, times = np.unique(words.hashes().view(np.int64), return_inverse=True, return_counts=True)
            n = np.bincount(of, learn[row:end][words.text_of_word()], len(found)).astype(np.int64)
            columns = (np.append(found, END_WORD), np.append(n, learn[row:end].sum()), np.append(times, end - row))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["word", "n", "seen"])


def _bound(counts: DataFrame, most: int) -> int:
    """Least count such that at most ``most`` rows have a larger one."""
    level = F.floor(F.log2(F.col("seen").cast("double")) * 16).cast("int")
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.max("seen").alias("top")).orderBy(F.desc("level")).collect()
    total = 0
    for row in rows:  # at most 1,024 levels
        total += row["rows"]
        if total > most:
            return row["top"]
    return 0


def _vocabulary(counts: DataFrame, max_frequent: int, bucket: int) -> dict[str, np.ndarray]:
    """Arrays of the most frequent words, and the totals of all.

    ``kinds`` and ``times``, by code, are the buckets that a word's occurrences
    would fill and those in training texts; the last entry is the text's end.
    """
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in (F.when(F.col("n") > 0, 1), "n", "seen")]
    distinct, tokens, seen = counts.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
    frequent = counts.filter(F.col("seen") > _bound(counts, max_frequent)).toArrow()
    word, n, often = (frequent.column(x).to_numpy() for x in ("word", "n", "seen"))
    order = np.argsort(word.view(np.uint64))
    word, n, often = word[order].view(np.uint64), n[order], often[order]
    rank = np.empty(len(word), dtype=np.uint32)
    rank[np.lexsort((word, -often))] = np.arange(len(word))
    everything = tokens + distinct + 1
    share = np.empty(len(word))
    share[rank] = (n + 1) / everything
    known = n > 0
    rare = max(1 - share[rank[known]].sum(), 1 / everything) / (distinct - known.sum() + 1)
    end = np.flatnonzero(word.view(np.int64) == END_WORD)
    kinds, times = np.ones(len(word) + 1, dtype=np.uint64), np.zeros(len(word) + 1, dtype=np.int64)
    kinds[rank], times[rank] = -(-often // bucket), n
    kinds[-1], times[-1] = (kinds[rank[end[0]]], n[end[0]]) if len(end) else (1, 0)
    return {"words": word, "n": n, "rank": rank, "share": share, "rare": np.array([rare]), "kinds": kinds, "times": times, "totals": np.array([tokens, distinct, seen], dtype=np.int64)}


def _base(model):
    """Rows of texts with what the frequent words give, and rows of their other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.value
        index, n = HashIndex(vocabulary["words"]), vocabulary["n"]
        everything = int(vocabulary["totals"][:2].sum()) + 1
        learnt = np.append(n > 0, False)
        log_n = np.append(np.log10((n + 1.0) / everything), 0.0)  # the last for words that are not frequent
        end_at = index.find(np.array([END_WORD], dtype=np.int64).view(np.uint64))[0]
        end_n = int(n[end_at]) if end_at >= 0 else 0
        names = ["key", "doc_id", "n_tokens", "n_known", "base_score", "word", "n"]
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE):
                words = Words(data, offsets, lower=True)
                texts, of, hashes = end - row, words.text_of_word(), words.hashes()
                at = index.find(hashes)
                keys = batch.column("key").slice(row, texts)
                base = np.bincount(of, log_n[at], texts) + math.log10((end_n + 1) / everything)
                known = np.bincount(of, (at >= 0) & learnt[at], texts).astype(np.int64) + int(end_n > 0)
                columns = [keys, batch.column("doc_id").slice(row, texts), pa.array(words.count.astype(np.int64) + 1), pa.array(known), pa.array(base)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(texts, pa.int64()), pa.nulls(texts, pa.int64())], names=names)
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    text, word = of[rare], hashes[rare]
                    by = np.lexsort((word, text))
                    text, word = text[by], word[by]
                    fresh = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (word[1:] != word[:-1])))
                    m = len(fresh)
                    empty = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
                    times = np.diff(np.append(fresh, len(text)))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(text[fresh])), *empty, pa.array(word[fresh].view(np.int64)), pa.array(times)], names=names)

    return run


def _codes(hashes: np.ndarray, index: HashIndex, rank: np.ndarray) -> np.ndarray:
    """32-bit codes of words: ranks of the frequent ones, hashes above ``COMMON`` for others."""
    at = index.find(hashes)
    other = COMMON + 1 + (hashes >> np.uint64(32)) % np.uint64(END - COMMON - 1)
    return np.where(at >= 0, rank[at] if len(rank) else 0, other).astype(np.uint32)


def _slice_tokens(words: Words, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(v, u, w, text, place)`` of every token, ends included.

    ``v`` is the word before and ``u`` the one before that; ``place`` counts within the text.
    """
    ends = words.first[1:] + np.arange(len(words.count))
    w = np.empty(len(codes) + len(ends), dtype=np.uint32)
    w[np.arange(len(codes)) + words.text_of_word()] = codes
    w[ends] = END
    v = np.append(np.uint32(END), w[:-1])  # a text's end stands before the next text's start
    u = np.append(np.uint32(END), v[:-1])
    first = np.append(0, ends[:-1] + 1)
    u[first] = END
    text = np.repeat(np.arange(len(ends)), words.count + 1)
    return v, u, w, text, np.arange(len(w)) - first[text]


def _own(code: np.ndarray, by_code: np.ndarray, other: int) -> np.ndarray:
    """Entries by word code; ``other`` for words that are not frequent."""
    last = len(by_code) - 1
    at = np.where(code == END, last, np.minimum(code, last))
    return np.where((code < last) | (code == END), by_code[at], by_code.dtype.type(other))


def _which(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Place of each key among the ascending ``some``, or -1."""
    if not len(some):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(some, keys), len(some) - 1)
    return np.where(some[at] == keys, at, -1)


def _joint(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def _split_pairs(model):
    """Counts of pairs of neighbours that are both split words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.value
        index = HashIndex(vocabulary["words"])
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE, SLICE_ROWS):
                words = Words(data, offsets, lower=True)
                v, _, w, text, _ = _slice_tokens(words, _codes(words.hashes(), index, vocabulary["rank"]))
                both = np.flatnonzero((_own(v, vocabulary["kinds"], 1) > 1) & (_own(w, vocabulary["kinds"], 1) > 1) & (w != END))
                pair, of, times = np.unique(_joint(w[both], v[both]), return_inverse=True, return_counts=True)
                n = np.bincount(of, learn[row:end][text[both]], len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (pair.view(np.int64), n, times)], names=["pair", "n", "seen"])

    return run


def _crowded(texts: DataFrame, model, vocabulary: dict[str, np.ndarray], bucket: int) -> dict[str, np.ndarray]:
    """Contexts of two words that fill more than two buckets, and their training tokens.

    There are at most half as many as buckets, and the texts' starts.
    """
    rows = []
    if vocabulary["kinds"].max() > 1:
        counts = texts.select("learn", "text").mapInArrow(_split_pairs(model), "pair long, n long, seen long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
        rows = [(r["pair"], r["n"], r["seen"]) for r in counts.filter(F.col("seen") > 2 * bucket).collect()]
    if vocabulary["kinds"][-1] > 1:
        rows.append((-1, int(vocabulary["times"][-1]), int(vocabulary["kinds"][-1]) * bucket))  # the end and the end
    context, n, seen = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1, 2))
    order = np.argsort(context.view(np.uint64))
    return {"context": context.view(np.uint64)[order], "n": n[order], "pieces": -(-seen[order] // (PIECE * bucket))}


def _dealt(model, crowded: dict[str, np.ndarray], buckets: int):
    """One row for each slice and bucket, the slice's tokens of that bucket, and one with the slice's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.value
        index = HashIndex(vocabulary["words"])
        for batch in batches:
            keys, learn = batch.column("key").to_numpy(), batch.column("learn").to_numpy(zero_copy_only=False)
            for row, end, data, offsets in text_slices(batch.column("text"), SLICE, SLICE_ROWS):
                words, own = Words(data, offsets, lower=True), keys[row:end]
                v, u, w, text, place = _slice_tokens(words, _codes(words.hashes(), index, vocabulary["rank"]))
                name = int(np.bitwise_xor.reduce(mix(own.view(np.uint64) + np.arange(1, len(own) + 1, dtype=np.uint64))).view(np.int64))
                kinds = _own(v, vocabulary["kinds"], 1)
                draw, kind = u.astype(np.uint64), np.zeros(len(v), dtype=np.uint64)
                split = np.flatnonzero(kinds > 1)
                apart = split[_which(_joint(v[split], u[split]), crowded["context"]) >= 0]
                draw[apart] = own.view(np.uint64)[text[apart]] + (place[apart] >> 10).astype(np.uint64)
                kind[split] = mix(draw[split]) % kinds[split]
                where = mix(_joint(v, kind)) % np.uint64(buckets)
                order = np.lexsort((_joint(u, w), _joint(where, v)))
                cut = np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
                filled = np.flatnonzero(np.diff(cut))
                ends = np.append(np.append(cut[filled], len(order)), len(order)).astype(np.int32)  # no tokens beside the keys
                mark = (text * 2 + learn[row:end][text]).astype(np.int16)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c[order])) for c in (v.view(np.int32), u.view(np.int32), w.view(np.int32), mark)]
                slice_keys = pa.array([None] * len(filled) + [own], pa.list_(pa.int64()))
                bucket = np.append(filled, name % buckets)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), name)), slice_keys, *lists], names=_DEALT)

    return run


_DEALT = ["bucket", "slice", "keys", "v", "u", "w", "mark"]


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    column = rows.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False)


def _asked(model, crowded: dict[str, np.ndarray], parts: int):
    """What a bucket has of the bigrams of split words, and of the trigrams after crowded contexts, a row for each part that sums them.

    A negative ``n`` asks for how many words follow the word or context; all parts with pieces of it are asked.
    """

    def run(rows: pa.Table) -> pa.Table:
        kinds = model.value["kinds"]
        v, u, w = (_flat(rows, name).view(np.uint32) for name in ("v", "u", "w"))
        split = np.flatnonzero(_own(v, kinds, 1) > 1)
        v, u, w, learn = v[split], u[split], w[split], _flat(rows, "mark")[split] & 1
        pair, of = np.unique(_joint(v, w), return_inverse=True)
        which = _which(_joint(v, u), crowded["context"])
        apart = np.flatnonzero(which >= 0)
        triple, of_triple = np.unique(_joint(which[apart], w[apart]), return_inverse=True)
        context = (triple >> np.uint64(32)).astype(np.int64)
        after = _joint(crowded["context"][context] >> np.uint64(32), triple & np.uint64(END))
        n = np.append(np.bincount(of, learn, len(pair)), np.bincount(of_triple, learn[apart], len(triple))).astype(np.int64)
        context, pair = np.append(np.full(len(pair), -1), context), np.append(pair, after)

        def pieces(context: np.ndarray, v: np.ndarray) -> np.ndarray:
            count = -(-_own(v, kinds, 1).astype(np.int64) // PIECE)
            of_context = np.flatnonzero(context >= 0)
            count[of_context] = crowded["pieces"][context[of_context]]
            return count

        def part_of(context: np.ndarray, v: np.ndarray, piece: np.ndarray) -> np.ndarray:
            return mix(_joint(v, piece) ^ mix((context + 2).astype(np.uint64))) % np.uint64(parts)

        v = pair >> np.uint64(32)
        part = part_of(context, v, mix(pair & np.uint64(END)) % pieces(context, v).astype(np.uint64))
        heads = np.unique(_joint(context + 1, v))
        of_head, v = (heads >> np.uint64(32)).astype(np.int64) - 1, heads & np.uint64(END)
        each = pieces(of_head, v)
        at, piece = np.repeat(np.arange(len(heads)), each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        asks = np.unique(_joint(at, part_of(of_head[at], v[at], piece)))  # a part that has several pieces is asked once
        at = (asks >> np.uint64(32)).astype(np.int64)
        context, pair, n = np.append(context, of_head[at]), np.append(pair, v[at] << np.uint64(32)), np.append(n, np.full(len(asks), -1))
        part = np.append(part, asks & np.uint64(END))
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        filled = np.flatnonzero(np.diff(cut))
        ends = pa.array(np.append(cut[filled], len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in (context.astype(np.int32), pair.view(np.int64), n)]
        bucket = np.full(len(filled), rows.column("bucket")[0].as_py())
        return pa.table([pa.array(filled), pa.array(bucket), *lists], names=["part", "bucket", "context", "pair", "n"])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """What buckets asked of one part, in their order: sums over all buckets, and how many words that occur follow."""
    context, pair, n = _flat(rows, "context").astype(np.int64), _flat(rows, "pair").view(np.uint64), _flat(rows, "n")
    asks = n < 0
    own = np.flatnonzero(~asks)
    order = own[np.lexsort((pair[own], context[own]))]
    heads = np.append(True, (np.diff(context[order]) != 0) | (pair[order][1:] != pair[order][:-1]))[: len(order)]
    first = np.flatnonzero(heads)
    total = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    above = _joint(context + 1, pair >> np.uint64(32))
    found, kinds = np.unique(above[order[first[total > 0]]], return_counts=True)
    given = np.empty(len(n), dtype=np.int64)
    given[order] = total[np.cumsum(heads) - 1]
    given[asks] = np.append(kinds, 0)[_which(above[asks], found)]
    ends = pa.array(np.append(0, np.cumsum(pc.list_value_length(rows.column("n")).to_numpy())).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (context.astype(np.int32), pair.view(np.int64), given, asks)]
    return pa.table([rows.column("bucket"), *lists], names=["bucket", "context", "pair", "n", "kinds"])


def _counted(keys: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and their counts, those of ``more`` given."""
    own, times = np.unique(keys, return_counts=True)
    every, count = np.append(own, more), np.append(times, n)
    order = np.argsort(every)
    return every[order], count[order]


def _part(v: np.ndarray, u: np.ndarray, w: np.ndarray, share: np.ndarray, rare: float, discount: float, given: dict[str, np.ndarray] | None = None) -> Trie:
    """The trie of training tokens ``(v, u, w)`` of one bucket.

    ``given`` says which tokens are of split words and of crowded contexts, and has the
    counts of those in all buckets.
    """
    none = np.zeros(0, dtype=np.uint64)
    if given is None:
        given = {"split": np.zeros(len(v), bool), "crowded": np.zeros(len(v), bool)} | {x: none for x in ("pairs", "pair_n", "triples", "triple_n", "v", "v_n", "v_kinds", "contexts", "context_n", "context_kinds")}
        given["triple_contexts"] = none
    wide, low32 = np.uint64(32), np.uint64(END)
    unigram = lambda word: np.where(word < len(share), share[np.minimum(word, len(share) - 1)] if len(share) else rare, rare)

    one = ~given["split"]
    pairs, pair_n = _counted(_joint(v[one], w[one]), given["pairs"], given["pair_n"])
    lower = np.unique(np.append(v[one].astype(np.uint64), given["v"]))
    low = np.searchsorted(lower, pairs >> wide)
    low_n, low_kinds = np.bincount(low, pair_n, len(lower)), np.bincount(low, minlength=len(lower))
    at = np.searchsorted(lower, given["v"])
    low_n[at], low_kinds[at] = given["v_n"], given["v_kinds"]
    pairs = _joint(low, pairs & low32)
    back2 = discount * low_kinds / np.maximum(low_n, 1)
    p2 = (pair_n - discount) / low_n[low] + back2[low] * unigram((pairs & low32).astype(np.int64))

    one = ~given["crowded"]
    own = _joint(v[one], u[one])
    contexts = np.unique(np.append(own, given["contexts"]))
    triples, triple_n = _counted(_joint(np.searchsorted(contexts, own), w[one]), _joint(np.searchsorted(contexts, given["triple_contexts"]), given["triples"]), given["triple_n"])
    high = (triples >> wide).astype(np.int64)
    high_n, high_kinds = np.bincount(high, triple_n, len(contexts)), np.bincount(high, minlength=len(contexts))
    at = np.searchsorted(contexts, given["contexts"])
    high_n[at], high_kinds[at] = given["context_n"], given["context_kinds"]
    contexts = _joint(np.searchsorted(lower, contexts >> wide), contexts & low32)
    back3 = discount * high_kinds / np.maximum(high_n, 1)
    below = (contexts[high] >> wide << wide) | (triples & low32)
    p3 = (triple_n - discount) / high_n[high] + back3[high] * p2[np.searchsorted(pairs, below)]
    return Trie(mapped(pack(build(lower, pairs, contexts, triples, p2, p3, back2, back3))))


def _of_all_buckets(rows: pa.Table, vocabulary: dict[str, np.ndarray], crowded: dict[str, np.ndarray], end: int) -> dict[str, np.ndarray]:
    """The given counts as :func:`_part` takes them, the text's end under its code as a word."""
    of_context = _flat(rows, "kinds")
    context, pair, n = _flat(rows, "context").astype(np.int64), _flat(rows, "pair"), _flat(rows, "n")
    # A word or context has a number of each part with pieces of it.
    heads, piece = np.unique(_joint(context[of_context] + 1, pair.view(np.uint64)[of_context] >> np.uint64(32)), return_inverse=True)
    some, words = (heads >> np.uint64(32)).astype(np.int64) - 1, heads & np.uint64(END)
    kinds = np.bincount(piece, n[of_context], len(heads)).astype(np.int64)
    context, pair, n = context[~of_context], pair[~of_context], n[~of_context]
    v, w = pair.view(np.uint64) >> np.uint64(32), pair.view(np.uint64) & np.uint64(END)
    w = np.where(w == END, np.uint64(end), w)
    of_pair, of_triple = np.flatnonzero(context < 0), np.flatnonzero(context >= 0)
    lower = some < 0
    words, words_kinds = words[lower], kinds[lower]
    words_n = _own(words, vocabulary["times"], 0)
    learnt = words_n > 0
    some, some_kinds = some[~lower], kinds[~lower]
    some_n = crowded["n"][some]
    after = some_n > 0
    of_pair, of_triple = of_pair[n[of_pair] > 0], of_triple[n[of_triple] > 0]
    return {
        "pairs": _joint(v[of_pair], w[of_pair]), "pair_n": n[of_pair], "v": words[learnt], "v_n": words_n[learnt], "v_kinds": words_kinds[learnt],
        "triples": w[of_triple], "triple_contexts": crowded["context"][context[of_triple]], "triple_n": n[of_triple],
        "contexts": crowded["context"][some[after]], "context_n": some_n[after], "context_kinds": some_kinds[after],
    }


def _scored(model, crowded: dict[str, np.ndarray], discount: float):
    """Scores of one bucket's tokens, summed by slice and text, in steps of the codes."""

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        vocabulary = model.value
        share, rare = vocabulary["share"], float(vocabulary["rare"][0])
        end = np.flatnonzero(vocabulary["words"].view(np.int64) == END_WORD)
        # The end is a word like others, under the code after all frequent ones.
        share = np.append(share, share[vocabulary["rank"][end[0]]] if len(end) else rare)
        v, u, w = (_flat(rows, name).view(np.uint32) for name in ("v", "u", "w"))
        w = np.where(w == END, len(share) - 1, w).astype(np.uint32)
        mark = _flat(rows, "mark")
        learn = np.flatnonzero(mark & 1)
        own = v[learn], u[learn], w[learn]
        counts = _of_all_buckets(given, vocabulary, crowded, len(share) - 1)
        counts["split"] = _own(own[0], vocabulary["kinds"], 1) > 1
        counts["crowded"] = _which(_joint(own[0], own[1]), crowded["context"]) >= 0
        trie = _part(*own, share, rare, discount, counts)
        unigram = np.where(w < len(share), share[np.minimum(w, len(share) - 1)], rare)
        value = trie.score(v, u, w, units(unigram).astype(np.int64))
        del trie, unigram, learn, own, counts, u, w
        sizes = pc.list_value_length(rows.column("v")).to_numpy()
        text = np.repeat(np.arange(len(rows)), sizes) << 16 | (mark >> 1)
        order = np.argsort(text, kind="stable")
        # A sum of at most 2^13 tokens, of three codes each, has 31 bits.
        heads = np.flatnonzero(np.append(True, np.diff(text[order]) > 0)[: len(order)] | (np.arange(len(order)) % (1 << 13) == 0))
        found = text[order][heads]
        first = pa.array(np.searchsorted(found, np.arange(len(rows) + 1) << 16).astype(np.int32))
        sums = np.add.reduceat(value[order], heads) if len(heads) else np.zeros(0)
        lists = [pa.ListArray.from_arrays(first, pa.array(c)) for c in ((found & 0xFFFF).astype(np.int16), sums.astype(np.int32))]
        return pa.table([rows.column("slice"), rows.column("keys"), *lists], names=["slice", "keys", "text", "score"])

    return run


def _gathered(rows: pa.Table) -> pa.Table:
    """Scores of the texts of one slice, or of equal slices, whose sums are equal as well."""
    named = rows.filter(pc.is_valid(rows.column("keys")))
    copies = len(named)
    keys = named.column("keys")[0].values.to_numpy()
    score = np.bincount(_flat(rows, "text").astype(np.int64), _flat(rows, "score"), len(keys)) / copies
    return pa.table({"key": np.tile(keys, copies), "score": -np.tile(score, copies) / STEPS})


def score_texts(docs: DataFrame, learn: F.Column, max_frequent: int = COMMON, bucket: int = 1 << 19, discount: float = 0.75) -> DataFrame:
    """Return ``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The rows that ``learn`` holds for are the training texts. ``base_score`` sums
    add-one unigram logarithms, ``score`` is the trie model's base-10 log
    probability; both are rounded to six places.
    """
    if max_frequent > COMMON:
        raise ValueError(f"at most {COMMON} frequent words have codes")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    base = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text.alias("text"))
    counts = base.select("learn", "text").mapInArrow(_word_counts, "word long, n long, seen long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    counts = written(counts, "word-counts")
    vocabulary = _vocabulary(counts, max_frequent, bucket)
    tokens = int(vocabulary["totals"][0])
    everything = float(vocabulary["totals"][:2].sum() + 1)
    model = spark.sparkContext.broadcast(vocabulary)

    of_texts = base.drop("learn").mapInArrow(_base(model), "key long, doc_id long, n_tokens long, n_known long, base_score double, word long, n long")
    # Rows of texts as such take part under keys of their own, spread over all tasks.
    joined = of_texts.withColumn("at", F.coalesce("word", "key")).join(counts.select(F.col("word").alias("at"), F.col("n").alias("c")), "at", "left")
    c, rare = F.coalesce("c", F.lit(0)), F.col("word").isNotNull()
    plain = joined.select(
        "key",
        "doc_id",
        F.when(rare, 0).otherwise(1).alias("copies"),
        "n_tokens",
        F.when(rare & (c > 0), F.col("n")).otherwise(F.coalesce("n_known", F.lit(0))).alias("n_known"),
        F.when(rare, F.col("n") * F.log10((c + 1) / F.lit(everything))).otherwise(F.col("base_score")).alias("base_score"),
    )

    buckets = max(1, -(-int(vocabulary["totals"][2]) // bucket))
    crowded = _crowded(base, model, vocabulary, bucket)
    dealt = base.drop("doc_id").mapInArrow(_dealt(model, crowded, buckets), "bucket long, slice long, keys array<long>, v array<int>, u array<int>, w array<int>, mark array<smallint>")
    parts = max(1, -(-int(vocabulary["kinds"][vocabulary["kinds"] > 1].sum()) // PIECE))
    asked = dealt.groupBy("bucket").applyInArrow(_asked(model, crowded, parts), "part long, bucket long, context array<int>, pair array<long>, n array<long>")
    given = asked.groupBy("part").applyInArrow(_summed, "bucket long, context array<int>, pair array<long>, n array<long>, kinds array<boolean>")
    sums = dealt.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_scored(model, crowded, discount), "slice long, keys array<long>, text array<smallint>, score array<int>")
    scores = sums.groupBy("slice").applyInArrow(_gathered, "key long, score double")

    total = plain.unionByName(scores, allowMissingColumns=True).groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("copies", "n_tokens", "n_known", "base_score", "score")]
    )
    # Equal rows have one key and equal scores; both readings must have seen the same texts.
    each = [(F.col(x) / F.col("copies")).cast("long").alias(x) for x in ("n_tokens", "n_known")] + [F.round(F.col(x) / F.col("copies"), 6).alias(x) for x in ("base_score", "score")]
    same = F.assert_true(F.col("copies").isNotNull() & F.col("score").isNotNull(), F.lit("the table changed between two readings"))
    rows = total.withColumn("same", same).filter("same IS NULL").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select("doc_id", *each).select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
