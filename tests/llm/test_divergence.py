"""The divergence audit on odd rows against a restatement over dictionaries; its sketch never falls short."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helpers import LOW, make
from mnemolith.llm import divergence as module
from mnemolith.llm.divergence import divergence, possible_terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def restated(rows, least, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOW))) for _, text, lang, source in rows]
    groups, out = {(lang, source) for lang, source, _ in docs}, set()
    for lang in {g[0] for g in groups}:
        of_lang, frequency = {s: Counter() for x, s in groups if x == lang}, Counter()
        for x, source, terms in docs:
            if x == lang:
                of_lang[source].update(terms)
                frequency.update(set(terms))
        kept = sorted(t for t, n in frequency.items() if n >= least)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in of_lang.items()}, shares(sum(of_lang.values(), Counter()))
        for s in of_lang:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in of_lang if o != s]
            own = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if of_lang[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_odd_rows(spark, odd, odd_rows):
    for least in (2, 10, 1000):
        found = [tuple(r) for r in divergence(odd, least).collect()]
        assert len(found) == len(set(found)) and set(found) == restated(odd_rows, least)


def test_empty_table(spark, empty):
    assert divergence(empty).count() == 0


def test_sketch_never_falls_short_and_discards(spark):
    rows = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(i * 37, i * 37 + 300)), "en", "s") for i in range(200)]
    df = make(spark, rows).select("text", F.col("lang"))
    bits = np.unpackbits(possible_terms(df, 3), axis=1).astype(bool)
    by_document = Counter(t for _, text, *_ in rows for t in set(text.split()))
    data = " ".join(by_document).encode()
    words = module.Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), lower=True)
    keys = module.mix(words.hashes() ^ module._salts([("en",)])[0])
    possible = np.logical_and.reduce([bits[r][module._slots(keys, r)] for r in range(module.DEPTH)])
    frequent = np.array([by_document[t] >= 3 for t in by_document])
    assert possible[frequent].all() and possible[~frequent].mean() < 0.1
