"""Toxicity by a subsequence string kernel and a Nystroem support vector machine.

The kernel of two words is the gap-weighted subsequence kernel of order three:
it counts common, possibly gapped, letter triples and discounts each by the
length it spans, so an insult with inserted or dropped characters stays close.
Normalised and sharpened as ``exp(sharpness * (k - 1))`` it is still a kernel.

Landmarks are the words most associated with toxic labels, of which spellings near
a chosen one are passed over, so that those of all languages find room. A sentence is
described by its greatest kernel value with each landmark over its words, a feature
map made of the word kernel, and mapped by the inverse square root of the
landmarks' kernel matrix (Nystroem). A linear
support vector machine is trained on sentences of labelled documents: of a
toxic document its most suspicious sentence, of others every sentence that is
near a landmark. A document's score is the calibrated probability of its worst
sentence.

Labels come from a bounded sample: an evenly hashed share of about ``max_labelled``
labelled documents. The model is at most ``landmarks`` words and weights, and is
broadcast. Scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts have no sentence near a landmark and get
the base probability; without labels of both kinds every score is 0; words and
runs of one-letter words over ``LONGEST`` letters are read in overlapping windows, and a
text of any length is read whole, in one task; kernel values below ``FLOOR`` count
as none: one letter inserted, dropped or replaced stays above it, and two
do in longer words; a null ``doc_id`` or label is not learnt from; words of equal
support are landmarks in code-point order; repeated rows are scored one by one;
extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import words as word_array
from .storage import written
from .tokens import Words, text_slices

LONGEST = 40
FLOOR = 0.3  # kernel values below count as none
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ends = np.zeros(256, dtype=bool)
_ends[[ord(c) for c in ".!?"]] = True
_drop = str.maketrans("", "", PUNCTUATION)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of each word in a row, padded with -1."""
    out = np.full((len(words), max([1, *map(len, words)])), -1, dtype=np.int32)
    for row, word in zip(out, words, strict=True):
        row[: len(word)] = np.frombuffer(word.encode("utf-32-le"), dtype=np.int32)
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``a`` with the same row of ``b``."""
    equal = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    ended = np.where(equal, decay * decay, 0.0)  # weight of the matches that end at a pair of letters
    for _ in range(order - 1):
        for i in range(1, ended.shape[1]):  # add matches that ended earlier, by letters since
            ended[:, i] += decay * ended[:, i - 1]
        for j in range(1, ended.shape[2]):
            ended[:, :, j] += decay * ended[:, :, j - 1]
        longer = np.zeros_like(ended)
        longer[:, 1:, 1:] = np.where(equal[:, 1:, 1:], decay * decay * ended[:, :-1, :-1], 0.0)
        ended = longer
    return ended.sum(axis=(1, 2))


@dataclass
class Kernel:
    """Sharpened kernel with a fixed list of landmark words."""

    landmarks: list[str]
    order: int = 3
    decay: float = 0.9
    sharpness: float = 3.0

    def __post_init__(self) -> None:
        self.codes = _codes(self.landmarks)
        self.own = np.maximum(subsequence_kernel(self.codes, self.codes, self.order, self.decay), 1e-12)
        least = 1 + np.log(FLOOR) / self.sharpness - 1e-9  # kernel value before it is sharpened
        self.alphabet = np.unique(self.codes[self.codes >= 0])
        self.bounds = [self._bound(w, least) for w in self.landmarks]
        self.lengths = np.array([len(w) for w in self.landmarks])
        self.cache: dict[int, np.ndarray | None] = {}

    def _bound(self, word: str, least: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """The word's letters, as places in the alphabet, and which of their sets allow a value of ``least``.

        By Cauchy-Schwarz a normalised value is at most the share, in norm, of
        those triples of the landmark whose letters all are in the other word.
        Above 12 letters only the lack of single letters is looked at.
        """
        codes = [ord(c) for c in word]
        letters = sorted(set(codes))
        weight: dict[tuple[int, int, int], float] = {}
        for i, j, k in combinations(range(len(codes)), 3):
            triple = codes[i], codes[j], codes[k]
            weight[triple] = weight.get(triple, 0.0) + self.decay ** (k - i + 1)
        at = np.searchsorted(self.alphabet, letters)
        total = sum(x * x for x in weight.values()) * least * least
        if len(letters) > 12:
            return at, np.array([sum(x * x for t, x in weight.items() if c not in t) >= total for c in letters]), False
        norm = np.zeros([2] * len(letters))
        for triple, x in weight.items():
            norm[tuple(int(c in triple) for c in letters)] += x * x
        for axis in range(len(letters)):
            norm = np.cumsum(norm, axis=axis)
        return at, norm.reshape(-1) >= total, True

    def near(self, words: list[str]) -> np.ndarray:
        """Words and landmarks whose kernel value can reach ``FLOOR``, by the letters that they share."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=bool)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.int32)
        if not len(letters):
            return out
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        place = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        known = self.alphabet[place] == letters
        has = np.zeros((len(words), len(self.alphabet)), dtype=bool)
        has[row[known], place[known]] = True
        for k, (at, enough, of_sets) in enumerate(self.bounds):
            own = has[:, at]
            if of_sets:
                out[:, k] = enough[own @ (1 << np.arange(len(at))[::-1])]
            else:
                out[:, k] = (own | enough).all(axis=1)
        return out

    def values(self, words: list[str], pairs: np.ndarray) -> np.ndarray:
        """Kernel values of words and landmarks where ``pairs`` asks for them, else 0."""
        out = np.zeros(pairs.shape)
        asked = np.flatnonzero(pairs.any(axis=1))
        asked = asked[np.argsort([len(words[i]) for i in asked], kind="stable")]
        for part in np.array_split(asked, max(1, len(asked) // 256)):  # of like length, so little is padded
            codes = _codes([words[i] for i in part])
            own = np.maximum(subsequence_kernel(codes, codes, self.order, self.decay), 1e-12)
            w, k = np.nonzero(pairs[part])
            for some in np.array_split(np.arange(len(w)), max(1, len(w) // 2048)):
                both = subsequence_kernel(codes[w[some]], self.codes[k[some]], self.order, self.decay)
                out[part[w[some]], k[some]] = np.exp(self.sharpness * (both / np.sqrt(own[w[some]] * self.own[k[some]]) - 1))
        return np.where(out < FLOOR, 0.0, out)

    def best(self, words: list[str]) -> np.ndarray:
        """Kernel values of words; those over ``LONGEST`` letters have the greatest of their windows'."""
        out = np.zeros((len(words), len(self.landmarks)))
        short = [i for i, w in enumerate(words) if 3 <= len(w) <= LONGEST]
        some = [words[i] for i in short]
        out[short] = self.values(some, self.near(some))
        for i, word in enumerate(words):
            if len(word) > LONGEST:
                # At every place, as long as a landmark, and two letters longer for spellings with more.
                for length, more in product(np.unique(self.lengths).tolist(), (0, 2)):
                    width = length + more
                    pieces = sorted({word[at : at + width] for at in range(max(len(word) - width, 0) + 1)})
                    for part in (pieces[at : at + 8192] for at in range(0, len(pieces), 8192)):
                        found = self.values(part, self.near(part) & (self.lengths == length))
                        out[i] = np.maximum(out[i], found.max(axis=0))
        return out

    def sentences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Text and description of each sentence that is near a landmark."""
        none = np.zeros(0, dtype=np.int64), np.zeros((0, len(self.landmarks)))
        if not len(words.start):
            return none
        hashes = words.hashes()
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.cache) > 500_000:
            self.cache.clear()
        fresh = [i for i, key in enumerate(keys) if key not in self.cache]
        if fresh:
            start, end = words.start[one], words.end[one]
            texts = [words.data[start[i] : end[i]].tobytes().decode("utf-8", "replace").lower().translate(_drop) for i in fresh]
            found = self.best(texts)
            for i, row, some in zip(fresh, found, found.any(axis=1).tolist(), strict=True):
                self.cache[keys[i]] = row.copy() if some else None
        hot = np.array([i for i, key in enumerate(keys) if self.cache[key] is not None], dtype=np.int64)
        slot = np.full(len(distinct), -1)
        slot[hot] = np.arange(len(hot))
        table = [self.cache[keys[i]] for i in hot.tolist()]
        place = np.flatnonzero(slot[back] >= 0)
        rows = slot[back][place]

        spelled, spelled_rows = self._spelled(words, words.end - words.start)
        if len(spelled):
            rows = np.append(rows, len(table) + np.arange(len(spelled)))
            place = np.append(place, spelled)
            table += list(spelled_rows)
        if not len(place):
            return none
        lines = np.append(0, np.cumsum(words.data == 10))
        text = words.text_of_word()
        fresh_sentence = np.zeros(len(words.start), dtype=np.int64)
        fresh_sentence[1:] = _ends[words.data[words.end[:-1] - 1]] | (lines[words.start[1:]] != lines[words.end[:-1]]) | (text[1:] != text[:-1])
        sentence = np.cumsum(fresh_sentence)[place]
        order = np.argsort(sentence, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(sentence[order]) > 0))
        described = np.maximum.reduceat(np.array(table)[rows[order]], heads, axis=0)
        return text[place[order][heads]], described

    def _spelled(self, words: Words, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of three or more one-letter words, read as one word."""
        single, text = np.flatnonzero(size == 1), words.text_of_word()
        broken = np.flatnonzero((np.diff(single) > 1) | (np.diff(text[single]) > 0)) + 1
        runs = [(int(r[0]), int(r[-1]) + 1) for r in np.split(single, broken) if len(r) >= 3]
        if not runs:
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(self.landmarks)))
        joined = [bytes(words.data[words.start[s:e]]).decode("utf-8", "replace").lower() for s, e in runs]
        values = self.best(joined)
        some = np.flatnonzero(values.any(axis=1))
        return np.array([runs[i][0] for i in some], dtype=np.int64), values[some]


def _covering(words: list[str], most: int, alike: float = 0.7) -> list[str]:
    """The first ``most`` words that are unlike all chosen before them, by the kernel before it is sharpened."""
    codes = _codes(words)
    own = np.maximum(subsequence_kernel(codes, codes, Kernel.order, Kernel.decay), 1e-12)
    near, chosen = np.zeros(len(words)), []
    for i in range(len(words)):
        if near[i] < alike and len(chosen) < most:
            chosen.append(words[i])
            for part in np.array_split(np.arange(len(words)), -(-len(words) // 512)):
                both = subsequence_kernel(codes[part], np.repeat(codes[i : i + 1], len(part), axis=0), Kernel.order, Kernel.decay)
                near[part] = np.maximum(near[part], both / np.sqrt(own[part] * own[i]))
    return chosen


def _described(kernel: Kernel):
    """Sentences of labelled documents to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("toxic").to_numpy()
            for row, end, data, offsets in text_slices(batch.column("text")):
                text, values = kernel.sentences(Words(data, offsets, lower=True))
                toxic = labels[row:end]
                weight = values.sum(axis=1)
                order = np.lexsort((-weight, text))
                top = np.zeros(len(text), dtype=bool)
                top[order[np.flatnonzero(np.append(True, np.diff(text[order]) > 0))[: len(order)]]] = True
                keep = np.flatnonzero(top | (toxic[text] == 0)) if len(text) else np.zeros(0, dtype=np.int64)
                rest = np.setdiff1d(np.arange(end - row), text)  # documents near nothing
                kinds = np.concatenate([toxic[text[keep]], toxic[rest]]).astype(np.int32)
                rows = np.concatenate([values[keep], np.zeros((len(rest), values.shape[1]))])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(list(rows), pa.list_(pa.float64()))], names=["toxic", "values"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge), by Newton steps; y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))])
    # Both kinds weigh alike.
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        short = y * (x @ w) < 1
        a = x[short] * cost[short, None]
        new = np.linalg.solve(a.T @ x[short] + ridge, a.T @ y[short])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _calibrated(margin: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to probability, by Newton steps."""
    x, t = np.column_stack([margin, np.ones(len(margin))]), toxic.astype(float)
    v = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        v = v + np.linalg.solve(h, x.T @ (t - p) - 1e-3 * v)
    return float(v[0]), float(v[1])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000, landmarks: int = 96, penalty: float = 1e-4, weakened: float = 0.6) -> dict | None:
    """Learn from ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; None without both labels."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_labelled / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = written(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"), "labelled")
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = kinds.get(1, 0), kinds.get(0, 0)
    if not bad or not good:
        return None

    plain = F.transform(word_array(F.lower("text")), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    by_word = sample.select("toxic", F.explode(F.array_distinct(plain)).alias("word")).filter(F.length("word").between(4, LONGEST))
    seen = by_word.groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).filter("a >= 4")
    expected = F.col("n") * (bad / (bad + good))
    excess = F.when(F.col("a") > expected, (F.col("a") - expected) ** 2 / (expected + 1)).otherwise(0)
    # As many words as the sample's documents can make pass; a few thousand for ten thousand documents.
    rows = seen.select("word", excess.alias("excess")).filter("excess > 12").orderBy(F.desc("excess"), "word").collect()
    if not rows:
        return None
    kernel = Kernel(_covering([r["word"] for r in rows], landmarks))
    rows = kernel.landmarks
    described = sample.select("text", "toxic").mapInArrow(_described(kernel), "toxic int, values array<double>").toArrow()
    values = np.array(described.column("values").to_pylist(), dtype=float).reshape(-1, len(rows))
    toxic = described.column("toxic").to_numpy()

    # An insult with a letter more or less has a lower kernel value, and labels seldom show one:
    # toxic sentences count a second time with their values weakened.
    values, toxic = np.concatenate([values, values[toxic == 1] * weakened]), np.append(toxic, toxic[toxic == 1])
    own = kernel.values(kernel.landmarks, np.ones((len(rows), len(rows)), dtype=bool))
    size, base = np.linalg.eigh((own + own.T) / 2)
    root = base / np.sqrt(np.maximum(size, 1e-3)) @ base.T  # Nystroem map
    weights = _fit(values @ root, np.where(toxic == 1, 1.0, -1.0), penalty)
    weights = np.append(root @ weights[:-1], weights[-1])
    slope, offset = _calibrated(values @ weights[:-1] + weights[-1], toxic)
    return {"landmarks": kernel.landmarks, "weights": weights, "slope": slope, "offset": offset}


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(model["landmarks"]) if model else None
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text")):
                score = np.zeros(end - row)
                if model:
                    text, values = kernel.sentences(Words(data, offsets, lower=True))
                    margin = np.full(end - row, model["weights"][-1])
                    np.maximum.at(margin, text, values @ model["weights"][:-1] + model["weights"][-1])
                    score = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(score)], names=["doc_id", "score"])

    return run


def score_texts(docs: DataFrame, model: dict | None) -> DataFrame:
    """Return ``doc_id, score`` for every row of ``docs``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scores(model), "doc_id long, score double")
