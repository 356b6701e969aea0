"""The whole pipeline against plain restatements of its stages, one after the other."""

import collections
import math

import duckdb
import numpy as np
import pandas as pd
import xxhash

import corpus_pipeline
from helpers import words
from mnemolith.llm.oracles import ORACLE_SQL
from mnemolith.llm.quality_rules import learn_rules
from mnemolith.llm.sharding import even_tree

SF = "/root/testdata/sf0.001"


def good(text, rules):
    """Whether a text passes the base test and no learnt rule holds."""
    w = words(text)
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(three)
    repeated = len({k + d for k, x in enumerate(three) if often[x] > 1 for d in range(3)})
    lines = [x for x in (text or "").split("\n") if words(x)]
    chars, n = sum(map(len, w)), max(len(w), 1)
    value = {
        "n_words": len(w), "mean_word": chars / n, "symbol_share": sum(c in "#*$%&|<>" for c in text or "") / max(chars, 1),
        "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_share": repeated / n,
    }
    if len(w) < 50 or 100 * repeated > 50 * len(w):
        return False
    return not any(all((value[t.statistic] > t.threshold) == t.above for t in rule) for rule in rules)


def representatives(docs):
    """The least document of each group of five-word shingle sets that reach 0.8, and those without words."""
    sets = {}
    for i, text in docs.items():
        w = words(text, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    kept, seen = [], set()
    for i in sorted(sets):
        if i in seen:
            continue
        kept.append(i)
        group = [i]
        while group:
            a = sets[group.pop()]
            near = [j for j, b in sets.items() if j not in seen and a and 100 * len(a & b) >= 80 * len(a | b)]
            seen.update(near)
            group += near
    return kept


def holds(item, text):
    """Whether some stretch of the text is the item with at most a fifth of its words in edits."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    at = np.arange(len(text) + 1)
    for n, word in enumerate(item, 1):
        new = np.append(n, np.minimum(row[:-1] + (text != word), row[1:] + 1))
        row = np.minimum.accumulate(new - at) + at
    return row.min() <= int(0.2 * len(item))


def shard_of(key, leaves):
    for level in range(3):
        weight = collections.Counter()
        for leaf in leaves:
            weight[leaf[level]] += leaf[3]

        def late(child, level=level, weight=weight):
            h = xxhash.xxh64(key.encode(), seed=xxhash.xxh64(f"{level}/{child}".encode(), seed=42).intdigest()).intdigest()
            return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight[child], child

        best = min(weight, key=late)
        leaves = [leaf for leaf in leaves if leaf[level] == best]
    return leaves[0][2]


def test_pipeline_by_brute_force(spark):
    docs, labels = (pd.read_parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rules = learn_rules(*(spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")))
    assert len(labels) and docs.doc_id.is_unique
    texts = {i: t for i, t in zip(docs.doc_id, docs.text, strict=True) if good(t, rules)}
    kept = representatives(texts)
    items = [np.array(words(t, lower=True)) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    clean = [i for i in kept if not any(holds(item, np.array(words(texts[i], lower=True))) for item in items)]
    assert len(docs) > len(texts) > len(kept) > len(clean) > 20
    con = duckdb.connect()
    con.register("documents", docs[docs.doc_id.isin(clean)])
    expected = collections.Counter()
    tree = even_tree(24)
    for doc_id, size, _, _, taken in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE_SQL['op2_mixing']})").fetchall():
        expected[doc_id, shard_of(str(doc_id), tree)] += taken // size if size else 0
    found = collections.Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, SF).select("doc_id", "shard").collect())
    assert found == +expected
