"""Operators against brute force on a table of odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from helpers import make, prose, remainder, words
from pyspark.sql import functions as F

import corpus_pipeline
from mnemolith.llm import language_model as lm
from mnemolith.llm import mixing, near_dedup, quality_rules, sharding, substring_dedup
from mnemolith.llm.licences import scan_licences


def test_substring_dedup(odd, odd_rows, empty):
    width = 35
    tokens = [words(t) for _, t, _, _ in odd_rows]
    counts = collections.Counter(tuple(w[k : k + width]) for w in tokens for k in range(len(w) - width + 1))
    expected = []
    for (i, *_), w in zip(odd_rows, tokens, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if counts[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    found = substring_dedup.remove_repeats(odd, width)
    assert sorted(map(repr, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(repr, expected))
    assert any(e[2] for e in expected)
    for r in found.collect():
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed_spans, r.removed_spans[1:], strict=False))
    assert substring_dedup.remove_repeats(empty, width).count() == 0


def _shingles(text, width):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _components(rows, width, percent):
    rows = [(i, _shingles(t, width)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return root, rows


def test_near_dedup(odd, odd_rows, empty):
    for width, percent in ((3, 85), (5, 80)):
        root, sets = _components(odd_rows, width, percent)
        expected = [(i, len(s), root(i), root(i) == i) for i, s in sets]
        expected += [(None, len(_shingles(t, width)), None, False) for i, t, *_ in odd_rows if i is None]
        found = near_dedup.near_duplicates(odd, width, percent).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_rows_of_one_doc_id_are_one_node(spark):
    chance = random.Random(9)
    a, b, c = (prose(chance, 60) for _ in range(3))
    rows = [(5, a), (5, b), (1, b), (8, a + " more"), (9, c), (9, c), (7, "")]
    found = near_dedup.near_duplicates(make(spark, [(i, t, None, None) for i, t in rows]), 3, 85).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(5, 1, False), (1, 1, True), (8, 1, False), (9, 9, True), (7, 7, True)}


def test_near_dedup_pairs_grow_linearly(spark, monkeypatch):
    """Two families of edited copies that share buckets: groups as brute force has them, pairs in proportion."""
    compared = []
    confirmed = near_dedup._confirmed

    def counting(pairs, *rest, **more):
        compared.append(pairs.count())
        return confirmed(pairs, *rest, **more)

    monkeypatch.setattr(near_dedup, "_confirmed", counting)
    totals = []
    for n in (60, 120, 240):
        chance = random.Random(12)
        first = [f"w{chance.randrange(100_000)}" for _ in range(200)]
        second = [f"v{k}" if k % 20 == 0 else w for k, w in enumerate(first)]
        rows = []
        for i in range(2 * n):
            own = list((first, second)[i % 2])
            own[chance.randrange(200)] = f"x{i}"
            rows.append((i, " ".join(own), None, None))
        compared.clear()
        found = near_dedup.near_duplicates(make(spark, rows), 3, 85).collect()
        root, _ = _components(rows, 3, 85)
        assert {(r.doc_id, r.component_id) for r in found} == {(i, root(i)) for i, *_ in rows}
        totals.append(sum(compared))
    assert totals[2] <= 2.6 * totals[1] <= 6.8 * totals[0], totals


def test_near_dedup_keeps_rows_that_are_nobodys_copy(spark, odd, odd_rows, empty):
    chance = random.Random(3)
    texts = [prose(chance, 60) for _ in range(7)]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, ""), (2, texts[2] + " more"), (None, texts[2]), (None, texts[4]), (5, texts[4]), (None, texts[5]), (None, texts[5] + " more"), (7, texts[6]), (7, texts[6])]
    docs = make(spark, [(i, t, None, None) for i, t in rows])
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept)
    least = [t for i, t in found if i == -1 and t.startswith(texts[5])]
    assert len(least) == 1
    assert found == sorted([(-1, texts[0]), (-1, texts[1]), (-1, least[0]), (1, texts[2]), (1, texts[3]), (1, ""), (5, texts[4]), (7, texts[6])])
    root, sets = _components(odd_rows, 5, 80)
    found = [(r.doc_id, r.text) for r in near_dedup.distinct_documents(odd, 5, 80).collect()]
    assert len(found) == len(set(found)) and {i for i, _ in found} == {i for i, s in sets if root(i) == i or not s} | {None}
    assert [t for i, t in found if i is None] == ["no id here"]
    assert near_dedup.distinct_documents(empty).count() == 0


def test_quality_counts_and_rules(spark, odd, odd_rows, empty):
    expected = []
    for i, t, *_ in odd_rows:
        w = words(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = collections.Counter(three)
        covered = {k + d for k, x in enumerate(three) if often[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        symbols = sum(c in "#*$%&|<>" for c in t or "")
        expected.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = quality_rules.with_counts(odd.select("doc_id", "text"))
    assert sorted(map(repr, map(tuple, counted.select(columns).collect()))) == sorted(map(repr, expected))

    clean = [(i, " ".join(f"word{(i * 7 + k * k) % 997}x{k}" for k in range(80)), "en", "s") for i in range(300)]
    dirty = [(1000 + i, " ".join(f"w{(i * 5 + k * k) % 997}x{k}$$$" for k in range(80)), "en", "s") for i in range(300)]
    docs = make(spark, clean + dirty)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in clean + dirty] + [(None, 0), (5, None), (99999, 0)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(docs, labels)
    kept = {r.doc_id for r in quality_rules.accepted(docs, rules).collect()}
    assert kept == {i for i, *_ in clean}
    assert quality_rules.accepted(docs, rules).columns == docs.columns
    assert quality_rules.learn_rules(docs, labels.limit(0)) == []
    assert quality_rules.judged(odd.select("doc_id", "text"), rules).filter("kept IS NULL OR base_failed IS NULL").count() == 0
    assert quality_rules.accepted(empty, rules).count() == 0


def test_verdicts_are_those_of_the_first_rule_that_holds(spark, odd, odd_rows):
    """``kept``, ``rule`` and ``base_failed`` of every row against the list read rule by rule."""
    rules = [(quality_rules.Test("mean_word", True, 6.0), quality_rules.Test("n_words", False, 100.0)), (quality_rules.Test("repeat_share", True, 0.02),), (quality_rules.Test("symbol_share", False, -1.0),)]
    named = [" and ".join(map(str, r)) for r in rules]
    rows = quality_rules.judged(odd, rules).collect()
    assert len(rows) == len(odd_rows) and {"given_n_words", "given_kept"} <= set(rows[0].asDict())
    verdicts = set()
    for r in rows:
        value = {"mean_word": r.word_chars / max(r.n_words, 1), "n_words": r.n_words, "repeat_share": r.n_repeat_words / max(r.n_words, 1), "symbol_share": r.n_symbols / max(r.word_chars, 1)}
        met = [all((value[t.statistic] > t.threshold) == t.above for t in rule) for rule in rules]
        first = named[met.index(True)] if any(met) else None
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.rule, r.base_failed, r.kept) == (first, failed, not failed and first is None)
        verdicts.add((first, failed))
    assert len(verdicts) >= 4


def _targets(sizes):
    """Water-filling, one capped source after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in sizes if s not in capped)
        level = (total - sum(2 * sizes[s] for s in capped)) / rest if rest else 0
        over = {s for s in sizes if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else weight[s] * level for s in sizes}
        capped |= over


def test_mixing(odd, odd_rows, empty):
    sizes = collections.Counter()
    longest = collections.Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += len(words(t))
        longest[s] = max(longest[s], len(words(t)))
    targets = _targets(dict(sizes))
    found = mixing.mix_sources(odd).collect()
    assert sorted(map(repr, ((r.doc_id, r.size, r.source) for r in found))) == sorted(map(repr, ((i, len(words(t)), s) for i, t, _, s in odd_rows)))
    taken = collections.Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)
    again = mixing.mix_sources(odd.repartition(7)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, map(tuple, again)))
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert collections.Counter(r.text for r in mixed.select("text").collect()) == collections.Counter({k: v for k, v in _copies(odd, found).items() if v})
    assert mixing.mix_sources(empty).count() == mixing.mixed(empty).count() == 0


def _copies(odd, found):
    texts = {r.key: r.text for r in odd.select(F.xxhash64("text").alias("key"), "text").collect()}
    total = collections.Counter()
    for r in found:
        total[texts[r.text_key]] += r.copies
    return total


def test_sharding(spark, odd, odd_rows, empty):
    many = make(spark, [(i, f"text {i % 50}", "en", "s") for i in range(3000)])
    tree = sharding.even_tree(24)
    for docs in (odd, many):
        rows = sharding.shard_rows(docs, tree).collect()
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    expected = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows]
    found = sharding.shard_rows(odd, tree).select("doc_id", "size", "text_crc32").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert all(90 <= n <= 165 for n in collections.Counter(r.shard for r in rows).values())
    # A changed weight moves rows only into or out of the subtrees above it.
    heavier = [(g, k, s, 3.0 if s == 9 else w) for g, k, s, w in tree]
    moved = many.select(sharding.shard_of(F.col("doc_id").cast("string"), tree).alias("a"), sharding.shard_of(F.col("doc_id").cast("string"), heavier).alias("b")).filter("a <> b").collect()
    place = {s: (g, k) for g, k, s, _ in tree}
    assert moved and all(place[r.b][0] == place[9][0] for r in moved)
    assert all(place[r.b][1] == place[9][1] for r in moved if place[r.a][0] == place[9][0])
    assert sharding.shard_rows(empty, tree).count() == 0


def test_shards_by_brute_force(spark):
    """The descent of every row against draws made one by one."""
    import xxhash

    tree = [(s // 6, s // 3, s, 1.0 + s % 4) for s in range(15)]

    def draw(level, child, key):
        h = xxhash.xxh64(key.encode(), seed=xxhash.xxh64(f"{level}/{child}".encode(), seed=42).intdigest()).intdigest()
        return ((h >> 11) + 0.5) / (1 << 53)

    def descend(key):
        leaves = tree
        for level in range(3):
            children = sorted({leaf[level] for leaf in leaves})
            weight = {c: sum(leaf[3] for leaf in leaves if leaf[level] == c) for c in children}
            best = children[0] if len(children) == 1 else min(children, key=lambda c: (-math.log(draw(level, c, key)) / weight[c], c))
            leaves = [leaf for leaf in leaves if leaf[level] == best]
        return leaves[0][2]

    docs = make(spark, [(i, "t", None, None) for i in [*range(1500), -5, None]])
    found = {r.doc_id: r.given_shard * 0 + r.shard for r in sharding.sharded(docs, tree).collect()}
    assert found == {i: descend("" if i is None else str(i)) for i in found}


def _trigram_model(texts, discount=0.75):
    """Interpolated absolute discounting over dictionaries of counts."""
    grams = [collections.Counter() for _ in range(3)]
    for t in texts:
        tokens = ["<e>", "<e>", *words(t, lower=True), "<e>"]
        for k in range(2, len(tokens)):
            for order in range(3):
                grams[order][tuple(tokens[k - order : k + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    after = [collections.defaultdict(list) for _ in range(3)]
    for order in (1, 2):
        for gram, c in grams[order].items():
            after[order][gram[:-1]].append(c)

    def probability(context, word):
        if not context:
            return (grams[0][(word,)] + 1) / (n + v + 1)
        seen = after[len(context)].get(context)
        below = probability(context[1:], word)
        return (max(grams[len(context)][(*context, word)] - discount, 0) + discount * len(seen) * below) / sum(seen) if seen else below

    return probability, grams[0], n, v


def test_language_model(odd, odd_rows, empty):
    learn = ~lm.held_out(F.col("doc_id"), 7, 2)
    probability, counts, n, v = _trigram_model([t for i, t, *_ in odd_rows if remainder(i, 7) != 2])
    expected = []
    for i, t, *_ in odd_rows:
        tokens = ["<e>", "<e>", *words(t, lower=True), "<e>"]
        base = sum(math.log10((counts[(w,)] + 1) / (n + v + 1)) for w in tokens[2:])
        score = sum(math.log10(probability(tuple(tokens[k - 2 : k]), tokens[k])) for k in range(2, len(tokens)))
        expected.append((repr(i), len(tokens) - 2, sum(counts[(w,)] > 0 for w in tokens[2:]), n, base, score))
    for most, bucket in ((lm.COMMON, 1 << 21), (lm.COMMON, 4_000), (lm.COMMON, 500), (200, 1_000)):
        found = [(repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_texts(odd, learn, most, bucket).collect()]
        assert [g[:4] for g in sorted(found)] == [e[:4] for e in sorted(expected)]
        assert all(abs(g[4] - e[4]) < 0.01 for g, e in zip(sorted(found), sorted(expected), strict=True))
        if most > 200:  # three codes at most are off by half a step each
            assert all(abs(g[5] - e[5]) <= 0.0004 * (e[1] + 1) for g, e in zip(sorted(found), sorted(expected), strict=True))
        assert sum(g[5] for g in found) > sum(g[4] for g in found)
    assert lm.score_texts(empty, learn).count() == 0
    blank = lm.score_texts(odd, F.lit(False)).collect()
    assert {r.train_tokens for r in blank} == {0} and all(r.score == r.base_score == 0 for r in blank)


def test_frequent_words_and_pairs_spread_over_buckets(spark, monkeypatch):
    """A pair of words that is a third of all tokens: no bucket holds more than about two buckets of tokens."""
    chance = random.Random(17)
    docs = make(spark, [(i, " ".join(chance.choice(["hot pair", "hot pair", f"w{chance.randrange(3000)} x{chance.randrange(3000)}"]) for _ in range(60)), "en", "s") for i in range(300)])
    seen = []
    grouped = type(docs).groupBy

    def watched(df, *columns):
        if columns and isinstance(columns[0], str) and columns[0] == "bucket" and "mark" in df.columns and not seen:
            seen.extend(r.n for r in grouped(df, "bucket").agg(F.sum(F.size("v")).alias("n")).collect())
        return grouped(df, *columns)

    whole = sorted(map(tuple, lm.score_texts(docs, ~lm.held_out(F.col("doc_id"), 7, 2)).collect()))
    monkeypatch.setattr(type(docs), "groupBy", watched)
    rows = lm.score_texts(docs, ~lm.held_out(F.col("doc_id"), 7, 2), bucket=1_000).collect()
    assert sorted(map(tuple, rows)) == whole  # the size of buckets changes no score
    assert sum(seen) == sum(r.n_tokens for r in rows) and len(seen) > 20 and max(seen) <= 5_000


def test_split_words_pairs_are_summed_in_arrays():
    """A row for each bucket and part, not for each pair; sums and kinds over all buckets, also where parts have several pieces."""
    chance = np.random.default_rng(23)
    kinds = np.array([9, 3, 1, 30, 1, 2], dtype=np.uint64)  # of words 0 to 4 and the end
    crowded = {"context": np.sort(lm._joint(np.array([0, 3]), np.array([1, 0]))), "n": np.array([1, 1]), "pieces": np.array([5, 1])}
    model, parts, asked, occurs = type("Shared", (), {"value": {"kinds": kinds}}), 4, [], collections.Counter()
    for bucket in range(6):
        v, u = (chance.integers(0, 5, 3_000).astype(np.uint32) for _ in range(2))
        w, mark = chance.integers(0, 400, 3_000).astype(np.uint32), chance.integers(0, 4, 3_000).astype(np.int16)
        w[chance.random(3_000) < 0.1] = lm.END
        lists = [pa.array([x.tolist()], pa.list_(kind)) for x, kind in ((v.view(np.int32), pa.int32()), (u.view(np.int32), pa.int32()), (w.view(np.int32), pa.int32()), (mark, pa.int16()))]
        asked.append(lm._asked(model, crowded, parts)(pa.table([pa.array([bucket]), *lists], names=["bucket", "v", "u", "w", "mark"])))
        for a, b, c, m in zip(v.tolist(), u.tolist(), w.tolist(), mark.tolist(), strict=True):
            if a in (0, 1, 3):
                occurs[-1, a, c] += m & 1
                if (a, b) in ((0, 1), (3, 0)):
                    occurs[0 if a == 0 else 1, a, c] += m & 1
    rows = pa.concat_tables(asked)
    assert len(rows) <= 6 * parts < 100 < len(occurs)
    given, follow = [{} for _ in range(6)], [collections.Counter() for _ in range(6)]
    for part in range(parts):
        for r in lm._summed(rows.filter(pc.equal(rows["part"], part))).to_pylist():
            for context, pair, n, is_kinds in zip(r["context"], r["pair"], r["n"], r["kinds"], strict=True):
                word = (pair >> 32) & lm.END
                if is_kinds:
                    follow[r["bucket"]][context, word] += n
                else:
                    assert (context, word, pair & lm.END) not in given[r["bucket"]]
                    given[r["bucket"]][context, word, pair & lm.END] = n
    different = collections.Counter((context, a) for (context, a, _), n in occurs.items() if n)
    assert all(f == different for f in follow)
    assert all(occurs[key] == n for g in given for key, n in g.items()) and set().union(*given) == set(occurs)


def test_probabilities_sum_to_one():
    chance = random.Random(4)
    v, u, w = (np.array([int(chance.paretovariate(0.8)) % 60 for _ in range(3_000)], dtype=np.uint32) for _ in range(3))
    share = np.full(64, 1 / 65)
    trie = lm._part(v, u, w, share, 1 / 65, 0.75)
    everything = np.append(np.arange(64), lm.COMMON + 5).astype(np.uint32)
    for context in [*zip(v[:40].tolist(), u[:40].tolist(), strict=True), (3, 9_999), (9_999, 3)]:
        a, b = (np.full(65, x, dtype=np.uint32) for x in context)
        assert 0.998 <= (10 ** (-trie.score(a, b, everything, np.full(65, round(math.log10(65) * 4096))) / 4096)).sum() <= 1.002


def test_licences(spark, empty):
    texts = {
        1: "Some prose here.\nLicensed under the Apache License, Version 2.0.",
        2: "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.",
        3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        4: "All rights reserved.",
        5: "A licence to print money.",
        6: "",
        7: None,
    }
    found = {r.doc_id: (r.licences, r.sentence_ids) for r in scan_licences(make(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    assert found[1][0] == ["Apache-2.0"] and found[2][0] == ["GPL-3.0-only", "CC-BY-NC-4.0"]
    assert found[3] == (["MIT"], ["MIT_GRANT", "MIT_NOTICE", "MIT_ASIS"])
    assert found[4] == (["UNMATCHED"], ["RESERVED"])
    assert found[5] == found[6] == found[7] == ([], [])
    assert scan_licences(empty).count() == 0


def test_licences_of_real_texts(spark):
    bsd2 = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the distribution.\n"
    )
    bsd3 = bsd2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used\nto endorse or promote products derived from this software without specific prior written permission.\n"
    one_line = bsd3.replace("\nand/or", " and/or").replace("used\nto", "used to")
    gnu = "This {} is free software{} you can redistribute it and/or\nmodify it under the terms of the GNU {} as published by\nthe Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    texts = [
        (bsd2, ["BSD-2-Clause"]),
        (bsd3, ["BSD-3-Clause"]),
        (one_line, ["BSD-3-Clause"]),
        (bsd3 + bsd2, ["BSD-3-Clause", "BSD-2-Clause"]),
        (gnu.format("program", ":", "General Public License", ",", "3"), ["GPL-3.0-or-later"]),
        (gnu.format("program", ";", "General Public License", ";", "2"), ["GPL-2.0-or-later"]),
        (gnu.format("library", ";", "Lesser General Public License", ";", "2.1"), ["LGPL-2.1-or-later"]),
        (gnu.format("program", ":", "Affero General Public License", ",", "3"), ["AGPL-3.0-or-later"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");', ["MPL-1.1"]),
        ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause\nint x;", ["GPL-2.0-only", "BSD-3-Clause"]),
        ("/* SPDX-License-Identifier: EPL-2.0 */", ["EPL-2.0"]),
        ("SPDX-License-Identifier: MIT. See the file.", ["MIT"]),
        ("This software is licensed under the Eclipse Public License, version 2.0.", ["EPL-2.0"]),
        ("This is not licensed under the MIT license.", []),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
        ("This file is licensed under the terms of the MIT license.", ["MIT"]),
        ("Released under the GNU GPL v3.", ["GPL-3.0-only"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("This package is distributed under the GNU General Public License version 3 or later.", ["GPL-3.0-or-later"]),
        ("You may use it, as it is available under the LGPLv2.1 or any later version.", ["LGPL-2.1-or-later"]),
        ("This code is dual-licensed: MIT and Apache-2.0.", ["Apache-2.0", "MIT"]),
        ("MIT License\n\nCopyright (c) 2020 Somebody", ["MIT"]),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", ["Apache-2.0"]),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.", ["GPL-3.0-only"]),
        ("The work was never released under the GPL version 2, whatever they say.", []),
        ("Mit dem Text kam eine Lizenz, licence, und mit ihr viel.", []),
        ("Copyright law is a subject of its own, and so are licences.", []),
        ("Copyright (c) 2020 Somebody. All rights reserved.", ["UNMATCHED"]),
    ]
    found = {r.doc_id: r.licences for r in scan_licences(make(spark, [(i, t, None, None) for i, (t, _) in enumerate(texts)])).collect()}
    assert [found[i] for i in range(len(texts))] == [expected for _, expected in texts]
