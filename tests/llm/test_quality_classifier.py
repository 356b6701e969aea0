"""Neighbour votes against loops, and their accuracy on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import words
from mnemolith.llm import quality_classifier as q
from mnemolith.llm.language_model import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return q.train(docs, labels.filter(~held_out(F.col("doc_id"), 4, 2)))


def test_held_out_labels(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = q.score_texts(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"), 4, 2)).select("score", "quality").collect()
    assert len(rows) > 60 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.97


def test_terms_of_a_text():
    text = "Foo foo BAR!! x | foo foo bar"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    of, columns = q._terms(data, np.array([0, len(data)]))
    low, pairs = words(text, lower=True), []
    for a, b in zip(low, low[1:]):
        pairs.append((a, b))
    repeated = sum(p in pairs[:i] for i, p in enumerate(pairs))
    by_distance = [sum(low[i] == low[i - d] for i in range(d, len(low))) for d in (1, 2)]
    assert len(columns) == len(low) * 2 + len(pairs) + repeated + sum(by_distance) and set(of) == {0}
    assert repeated == 1 and by_distance == [2, 0]


def test_votes_against_loops():
    chance = np.random.default_rng(1)
    near = chance.uniform(-1, 1, (20, 300)).astype(np.float32)
    model = {"neighbours": 25, "power": 8.0, "prior": 0.7, "quality": (chance.random(300) < 0.7).astype(np.float32)}
    for row, score in zip(near, q._votes(near, model), strict=True):
        top = sorted(range(300), key=lambda i: -row[i])[:25]
        weight = {i: max(float(row[i]), 0) ** 8 for i in top}
        assert score == pytest.approx((sum(w * model["quality"][i] for i, w in weight.items()) + 0.7 * 0.05) / (sum(weight.values()) + 0.05), rel=1e-5)


def test_blocks_and_odd_rows(spark, model, odd, odd_rows):
    found = q.score_texts(odd, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[600]) == 1  # repeated rows
    assert by_id[400] == by_id[401] == by_id[402] == {model["prior"]}  # without words


def test_labels_missing(spark, odd, empty):
    docs = odd.select("doc_id", "text")
    none = spark.createDataFrame([(1, None), (None, 1), (10**12, 0)], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in q.score_texts(odd, q.train(docs, none)).collect()} == {0.5}
    assert {r.score for r in q.score_texts(odd, q.train(docs, one)).collect()} == {1.0}
    assert q.score_texts(empty, q.train(docs, one)).count() == 0
    few = q.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1), (400, 0)], "doc_id long, quality int"))
    assert len({r.score for r in q.score_texts(odd, few).collect()}) > 2
