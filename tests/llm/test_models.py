"""Learnt operators: held-out accuracy, brute force of kernels and searches."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import make, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from mnemolith.llm import decontamination, elias_fano, language_id, toxicity
from mnemolith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_elias_fano_round_trip():
    chance = np.random.default_rng(1)
    for n, universe in ((0, 5), (1, 1), (7, 3), (500, 1000), (3000, 10**12), (2000, 2000)):
        values = np.sort(chance.integers(0, universe, n))
        block = elias_fano.mapped(elias_fano.pack({f"s.{k}": v for k, v in elias_fano.encode(values, universe).items()}))
        sequence = elias_fano.EliasFano(block, "s.")
        assert (sequence[np.arange(n)] == values).all() and (sequence.all() == values).all()
        asked = np.unique(np.concatenate([values, chance.integers(0, universe, 200)]))
        assert (sequence.successor(asked) == np.searchsorted(values, asked)).all()
        found = sequence.find(asked)
        assert all((f >= 0) == (a in set(values.tolist())) and (f < 0 or values[f] == a) for f, a in zip(found, asked, strict=True))


def _edit_distance(a, b):
    """Least edits that turn ``a`` into some stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, odd, empty):
    chance = random.Random(5)
    items = [(k, prose(chance, chance.randrange(15, 50), 3000)) for k in range(30)]
    rows, planted = [], {}
    for i in range(200):
        text = prose(chance, 150, 3000).split()
        if i % 2:
            k = chance.randrange(30)
            own = items[k][1].split()
            allowed = int(0.2 * len(own))
            for _ in range(chance.randrange(allowed + 1)):
                place = chance.randrange(len(own))
                own[place : place + 1] = chance.choice([["new"], [], [own[place], "more"]])
            at = chance.randrange(len(text))
            text[at:at] = own
            planted[i] = k
        rows.append((i, " ".join(text), "en", "s"))
    docs = make(spark, rows)
    benchmark = spark.createDataFrame([*items, (99, items[0][1]), (98, None), (97, "not here"), (96, ""), (None, "neither here")], "item_id long, text string")
    truth = set()
    for i, text, *_ in rows:
        for k, item in items:
            own = words(item, lower=True)
            if _edit_distance(own, words(text, lower=True)) <= int(0.2 * len(own)):
                truth.add((i, k))
    assert set(planted.items()) <= truth
    found = {(r.doc_id, r.item_id): r for r in decontamination.contamination(docs, benchmark).collect()}
    assert set(found) <= truth and len(found) >= 0.95 * len(truth)
    for (i, k), r in found.items():
        own = words(items[k][1], lower=True)
        assert r.edits == _edit_distance(own, words(rows[i][1], lower=True)) or r.edits <= int(0.2 * len(own))
    blocks = decontamination.contamination(docs, benchmark, block=7)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(found)
    clean = decontamination.uncontaminated(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(200)) - {i for i, _ in found}
    assert decontamination.contamination(odd, benchmark.limit(0)).count() == 0
    assert decontamination.uncontaminated(odd, benchmark).count() == odd.count()
    assert decontamination.contamination(empty, benchmark).count() == 0


def test_decontamination_recall_by_length():
    """Items of 1 to 60 words with no edits to all allowed ones, against the edit distance of all stretches."""
    from mnemolith.llm.tokens import Words, text_slices

    chance = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    draw = lambda n: [chance.choice(vocabulary) for _ in range(n)]
    for length in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 23, 31, 50, 60):
        most = int(0.2 * length)
        for edits in sorted({0, most // 2, most}):
            items = [" ".join(draw(length)) + f" id{i}" * (length > 1) for i in range(60)]
            items = [" ".join(t.split()[-length:]) for t in items]
            texts = []
            for item in items:
                own = item.split()
                for _ in range(edits):
                    at = chance.randrange(len(own))
                    own[at : at + 1] = chance.choice([[f"n{chance.randrange(999)}"], [], [own[at], f"n{chance.randrange(999)}"]])
                texts.append(" ".join(draw(20) + own + draw(chance.choice([0, 1, 30]))))
            model = decontamination._Items(list(enumerate(items)), 0.2, 0.99, 5)
            indexes, found = model.indexes(), {}
            for row, _, data, offsets in text_slices(pa.array(texts)):
                found |= {(row + m[0], items[model.ids[m[1]]]): m for m in model.matches(Words(data, offsets, lower=True), indexes)}
            caught = sum((i, item) in found for i, item in enumerate(items))
            assert caught == 60 if not edits else caught >= 56, (length, edits, caught)
            for (i, item), (_, _, start, n, e) in found.items():
                a, b = words(item, lower=True), words(texts[i], lower=True)
                assert e == _edit_distance(a, b) == _edit_distance(a, b[start : start + n]) and (e or b[start : start + n] == a)


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = QUERIES["op7_language_id"](spark, SF)
    joined = result.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(joined) > 20 and sum(r.lang == r.lang_pred for r in joined) >= 0.9 * len(joined)
    langs, tables = language_id.train(odd.filter("doc_id < 100"))
    rows = language_id.identify(odd, langs, tables).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {*langs, "und"}
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {400, 401, 402, 405} and all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(empty, langs, tables).count() == 0
    none = language_id.train(empty)
    assert none == ([], []) and {r.lang_pred for r in language_id.identify(odd, *none).collect()} == {"und"}


def test_code_lengths_follow_ppm():
    """Bits of each byte against a direct statement of PPM-C over dictionaries."""
    texts = {"a": b"abracadabra abracadabra", "b": b"banana bandana xyz"}
    counts = {}
    for lang, text in texts.items():
        for k in range(len(text)):
            context = (b"\0\0\0" + text)[k : k + 3]
            key = lang, int.from_bytes(context + text[k : k + 1], "big")
            counts[key] = counts.get(key, 0) + 1
    keys = sorted(counts)
    langs = sorted(texts)
    tables = language_id._tables(langs, np.array([langs.index(x) for x, _ in keys]), np.array([g for _, g in keys]), np.array([counts[k] for k in keys]))

    def probability(lang, context, byte):
        seen = {}
        for (name, gram), n in counts.items():
            if name == lang and (gram >> 8).to_bytes(3, "big").endswith(context):
                seen[gram & 255] = seen.get(gram & 255, 0) + n
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (total + kinds)
        below = probability(lang, context[1:], byte) if context else 1 / 256
        return (kinds / (total + kinds) if total else 1.0) * below

    sample = b"abra banana q\xc3"
    data = np.frombuffer(sample, dtype=np.uint8)
    bits = language_id.code_lengths(tables, language_id._grams(data, np.array([0, len(sample)])))
    for k, byte in enumerate(sample):
        context = (b"\0\0\0" + sample)[k : k + 3]
        for which, lang in enumerate(langs):
            assert bits[k, which] == pytest.approx(-np.log2(probability(lang, context, byte)), abs=1e-3)


def test_languages_are_the_shortest_codes(spark):
    """Predictions and scores against code lengths from dictionaries of counts."""
    chance = random.Random(6)
    alphabets = {"aa": "abcde ", "bb": "cdefg "}
    draw = lambda letters, n: "".join(chance.choice(letters) for _ in range(n))
    train = [(i, draw(alphabets[lang], 60), lang) for i, lang in enumerate(["aa", "bb"] * 15)]
    counts = {}
    for _, text, lang in train:
        data = b"\0\0\0" + text.encode()
        for k in range(3, len(data)):
            for order in range(4):
                table = counts.setdefault((lang, data[k - order : k]), {})
                table[data[k]] = table.get(data[k], 0) + 1

    def bits(lang, context, byte):
        seen = counts.get((lang, context), {})
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (total + kinds))
        below = bits(lang, context[1:], byte) if context else 8.0
        return below - math.log2(kinds / (total + kinds)) if total else below

    texts = [draw(alphabets[chance.choice(["aa", "bb"])], n) for n in (1, 2, 3, 8, 20, 40)] + [draw("abcdefg ", 12) for _ in range(10)]
    texts = [t for t in texts if t.strip()]
    docs = make(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    langs, tables = language_id.train(make(spark, [(i, t, lang, None) for i, t, lang in train]))
    found = {r.doc_id: r for r in language_id.identify(docs, langs, tables).collect()}
    for i, text in enumerate(texts):
        data = b"\0\0\0" + text.encode()
        cost = [sum(bits(lang, data[k - 3 : k], data[k]) for k in range(3, len(data))) for lang in ("aa", "bb")]
        best = min(range(2), key=lambda j: cost[j])
        assert found[i].code_bits == pytest.approx(min(cost), abs=1e-2) and found[i].lang_pred == ("aa", "bb")[best]
        assert found[i].score == pytest.approx(1 / sum(2 ** -(c - cost[best]) for c in cost), abs=1e-2)


def _kernel(a, b, order, decay):
    """Sum over all pairs of equal subsequences of the decay to both spans."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), order):
        for j in combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel():
    words_a, words_b = ["idiot", "abcab", "xx", "idiot"], ["idxiot", "cabba", "xxx", "toidi"]
    found = toxicity.subsequence_kernel(toxicity._codes(words_a), toxicity._codes(words_b), 3, 0.7)
    for value, a, b in zip(found, words_a, words_b, strict=True):
        assert value == pytest.approx(_kernel(a, b, 3, 0.7))


def test_words_that_reach_the_floor_are_compared():
    """The letter bound against all kernel values, on generated spellings; marks, long words and long runs."""
    from mnemolith.llm.tokens import Words

    chance = random.Random(8)
    insults = ["idiot", "moron", "worthless", "dummkopf", "incompréhensiblement", "abcdefghijklmn"]
    kernel = toxicity.Kernel(insults)
    spellings = ["id*ot".replace("*", ""), "idot", "mo*on".replace("*", "")]
    for insult in insults:
        for _ in range(150):
            letters = list(insult)
            for _ in range(chance.randrange(5)):
                at = chance.randrange(len(letters))
                letters[at : at + 1] = chance.choice([[], ["x"], [letters[at], "y"], [letters[at]] * 3])
            spellings.append("".join(letters)[: toxicity.LONGEST])
    spellings = [s for s in spellings if s]
    full = kernel.values(spellings, np.ones((len(spellings), len(insults)), dtype=bool))
    assert np.allclose(kernel.best([s for s in spellings if len(s) > 2]), full[[len(s) > 2 for s in spellings]], atol=1e-9) and (full > 0).sum() > 300

    def greatest(text):
        data = text.encode()
        _, values = kernel.sentences(Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), lower=True))
        return values[:, 0].max(initial=0.0)

    assert greatest("you i..d..i..o..t") == greatest("i--d--i--o--t there") == pytest.approx(1.0)
    assert greatest("an id*ot") >= toxicity.FLOOR
    assert greatest("zqzq" * 20 + "idiot" + "zqzq" * 20) >= toxicity.FLOOR
    assert greatest(" ".join("zqzq" * 15 + "idiot" + "zqzq" * 15)) >= toxicity.FLOOR
    assert greatest("zqzq" * 40) == 0


def test_toxicity_scores_by_brute_force(spark):
    """Sentences, kernel values, margins and scores of whole texts against plain loops."""
    import re

    from mnemolith.llm.toxicity import FLOOR, PUNCTUATION

    landmarks = ["idiot", "worthless", "moron"]
    model = {"landmarks": landmarks, "weights": np.array([2.0, 1.5, -0.5, -1.0]), "slope": 1.7, "offset": -0.3}
    texts = [
        "You idxiot! A fine day, worthles.\nmoron said. nothing here",
        "a harmless remark about worth and idioms",
        "i d i o t you are\nWORTH-LESS moronn. idiot worthless",
        "moron? moron moron",
        "a worthles moron",
        "",
        "x",
    ]

    def value(a, b):
        raw = _kernel(a, b, 3, 0.9) / math.sqrt(max(_kernel(a, a, 3, 0.9), 1e-12) * max(_kernel(b, b, 3, 0.9), 1e-12))
        sharp = math.exp(3.0 * (raw - 1))
        return sharp if sharp >= FLOOR else 0.0

    expected = []
    for text in texts:
        margins = [-1.0]
        for sentence in re.split(r"(?<=[.!?])\s+|\n", text.lower()):
            parts = words(sentence)
            runs = re.findall(r"(?:(?<=\s)|^)(?:\S\s+){2,}\S(?=\s|$)", sentence)
            parts += ["".join(words(r)) for r in runs]
            parts = ["".join(c for c in w if c not in PUNCTUATION) for w in parts]
            best = [max([value(w, m) for w in parts if len(w) > 2], default=0.0) for m in landmarks]
            if any(best):
                margins.append(sum(w * b for w, b in zip(model["weights"], best, strict=False)) - 1.0)
        expected.append(1 / (1 + math.exp(-(1.7 * max(margins) - 0.3))))
    docs = make(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected, abs=1e-9)
    assert len({round(x, 6) for x in expected}) >= 4


def test_toxicity_by_kind_of_change(spark):
    """Held-out spellings of learnt insults: the README states what short words with two changes give."""
    chance = random.Random(21)
    insults = ["idiot", "stupid", "moron", "worthless", "pathetic", "disgusting", "scumbag", "loathsome"]
    rows, labels = [], []
    for i in range(600):
        text = prose(chance, 60).split()
        if i % 4 == 0:
            text.insert(chance.randrange(60), insults[i // 4 % len(insults)])
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(make(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def inserted(word, n):
        letters = list(word)
        for at in sorted(chance.sample(range(1, len(word)), n), reverse=True):
            letters.insert(at, chance.choice("xzqk17"))
        return "".join(letters)

    def at_one(word, change):
        at = chance.randrange(1, len(word) - 2)
        return word[:at] + change(word[at : at + 2]) + word[at + 2 :]

    kinds = {
        "as it is": (0, lambda w: w),
        "capitals": (0, str.upper),
        "spaced": (0, " ".join),
        "marks": (0, lambda w: "".join(c + chance.choice(["", ".", "-"]) for c in w)),
        "inserted": (0, lambda w: inserted(w, 1)),
        "dropped": (0, lambda w: at_one(w, lambda x: x[1])),
        "swapped": (0, lambda w: at_one(w, lambda x: x[1] + x[0])),
        "doubled": (0, lambda w: at_one(w, lambda x: x[0] + x)),
        "replaced": (8, lambda w: at_one(w, lambda x: chance.choice("xzqk17") + x[1])),
        "two inserted": (8, lambda w: inserted(w, 2)),
    }
    texts, kind_of = [], {}
    for kind, (least, change) in kinds.items():
        for word in insults * 6:
            if len(word) >= least:
                text = prose(chance, 40).split()
                text.insert(chance.randrange(40), change(word))
                kind_of[len(texts)] = kind
                texts.append(" ".join(text))
    clean = len(texts)
    texts += [prose(chance, 60) for _ in range(200)]
    scores = {r.doc_id: r.score for r in toxicity.score_texts(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), model).collect()}
    for kind in kinds:
        of_kind = [scores[i] >= 0.3 for i, k in kind_of.items() if k == kind]
        assert sum(of_kind) >= 0.9 * len(of_kind), kind
    assert not any(scores[i] >= 0.3 for i in range(clean, len(texts)))


def test_toxicity(spark, odd, empty):
    chance = random.Random(2)
    insults = ["idiot", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(400):
        text = prose(chance, 60).split()
        if i % 4 == 0:
            text.insert(chance.randrange(60), chance.choice(insults))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(i % 4 == 0)))
    variants = {1000: "you idi.ot there", 1001: "so WORTHLESSS!", 1002: "i d i o t", 1003: "a pathettic one", 1004: "a harmless remark on paths", 1005: None, 1006: ""}
    docs = make(spark, rows + [(i, t, "en", "s") for i, t in variants.items()])
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert all((scores[i] >= 0.3) == bool(t) for i, t in labels)
    assert {i: scores[i] >= 0.3 for i in variants} == {i: i < 1004 for i in variants}, (model, {i: scores[i] for i in variants})
    assert toxicity.score_texts(odd, model).count() == odd.count() and toxicity.score_texts(empty, model).count() == 0
    assert toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score_texts(odd, None).collect()} == {0.0}


def test_pipeline(spark, tmp_path, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    current, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        current = spark.createDataFrame(stage(spark, current, SF).toArrow())
        sizes.append(current.count())
        if name != "sharding":
            assert current.columns == docs.columns
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5]
    assert {r.shard for r in current.select("shard").collect()} <= set(range(24))
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).select("doc_id", "shard").collect())) == sorted(map(repr, current.select("doc_id", "shard").collect()))
    # Odd rows: every stage gives whole rows of its input, clashing columns as they were.
    given = [repr(tuple(r)) for r in odd.collect()]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        found = stage(spark, odd, SF)
        assert found.columns == ([c if c != "shard" else "given_shard" for c in odd.columns] + ["shard"] if name == "sharding" else odd.columns)
        rows = [repr(tuple(r)) for r in (found.drop("shard") if name == "sharding" else found).collect()]
        assert set(rows) <= set(given) and rows
        if name in ("decontamination", "sharding"):
            assert sorted(rows) == sorted(given)
        if name in ("quality rules", "near-duplicates"):
            assert len(rows) < len(given)


def test_arrow_slices_keep_rows_whole():
    from mnemolith.llm.tokens import Words, rolling, span_hashes, text_slices

    texts = ["a bc", None, "", "  x\ty\x0bz ", "é漢 字", "q" * 50, "a bc"] * 3
    seen = []
    for row, end, data, offsets in text_slices(pa.chunked_array([pa.array(texts[:9]), pa.array(texts[9:])]), 16):
        found = Words(data, offsets)
        assert end - row == len(found.count)
        for k in range(end - row):
            own = range(found.first[k], found.first[k + 1])
            seen.append([bytes(data[found.start[i] : found.end[i]]).decode() for i in own])
    assert seen == [words(t) for t in texts]
    values = np.arange(20, dtype=np.uint64) % 5
    assert (rolling(values, 7) == span_hashes(values, np.arange(14), np.arange(14) + 7)).all() and rolling(values, 7)[0] == rolling(values, 7)[5]
