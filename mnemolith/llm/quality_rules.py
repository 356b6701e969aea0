"""Quality rules: an ordered decision list learnt from labelled documents.

Sequential covering. Each rule grows by the threshold test that adds most
information about rejected documents on a growing part of the labels, is pruned
on the other part, and covers its documents before the next rule grows. The
list becomes one ordered conditional expression over statistics of the text;
the first rule that holds rejects, and texts that no rule meets are kept.

The learner needs counts only. Thresholds are quantiles of each statistic, and
Spark counts the labelled documents by their places between thresholds, part
and label; at most ``max_labelled`` documents (an evenly hashed share of more) are
counted, which bounds the table of counts. Scoring covers all documents in one
pass without a shuffle or Python.

Defined cases: null and empty texts have zero statistics and fail the base test
on their number of words; documents without a label, or labelled twice, are
scored like others; without labels there is no rule; of tests that gain equally
the first statistic and least threshold is taken, and of rules that hold the
first one rejects; repeated rows are scored one by one; a text of any length is
counted whole, in one task; extra columns are kept, and those that have the name
of a count become ``given_`` and that name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import SPACES, let, making_room, packed, words
from .storage import written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]
STATISTICS = ["symbol_share", "mean_word", "dup_line_share", "repeat_share", "capital_share", "shout_share", "n_words"]


def _repeated_words(items: Column) -> Column:
    """Words covered by three-word windows found at least twice, for an array of words."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeats(ordered: Column) -> Column:
        twin = F.transform(
            ordered,
            lambda w, k: F.when((F.get(ordered, k + 1)["key"] == w["key"]) | (F.when(k > 0, F.get(ordered, k - 1)["key"]) == w["key"]), w["at"]),
        )
        return let(F.sort_array(F.filter(twin, lambda at: at.isNotNull())), covered)

    def of_keys(keys: Column) -> Column:
        marked = F.transform(keys, lambda key, k: F.struct(key.alias("key"), k.alias("at")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(F.sort_array(marked), repeats))

    def of_hashes(hashes: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), F.size(hashes) - 2)
        return let(F.transform(starts, lambda h, k: F.xxhash64(h, F.get(hashes, k + 1), F.get(hashes, k + 2))), of_keys)

    hashed = F.transform(items, lambda w: F.xxhash64(w))
    return F.when(F.size(items) < 4, F.lit(0)).otherwise(let(hashed, of_hashes))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and three more counts."""
    docs = making_room(docs, *COUNTS, "count_words", "count_lines", "base_failed", "rule", "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counts = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("words"), _repeated_words(w).alias("repeats")))
    repeated_lines = let(lines, lambda v: F.struct((F.size(v) - F.size(F.array_distinct(v))).alias("again"), F.size(v).alias("all")))
    dense = F.length(F.translate(text, SPACES, ""))
    return docs.withColumns({"count_words": counts, "count_lines": repeated_lines}).withColumns(
        {
            "n_words": F.col("count_words.words").cast("long"),
            "word_chars": dense.cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": F.col("count_lines.again").cast("long"),
            "n_repeat_words": F.col("count_words.repeats").cast("long"),
            "n_lines": F.col("count_lines.all").cast("long"),
            "n_capitals": (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long"),
            "n_shouts": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        }
    ).drop("count_words", "count_lines")


def _statistics() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": per("n_symbols", "word_chars"),
        "mean_word": per("word_chars", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "capital_share": per("n_capitals", "word_chars"),
        "shout_share": per("n_shouts", "word_chars"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Test:
    """``statistic`` above (or at most) ``threshold``."""

    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = _statistics()[self.statistic]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _labelled_counts(docs: DataFrame, labels: DataFrame, max_labelled: int, quantiles: int) -> tuple[list, dict[str, list[float]]]:
    """Counts by places between thresholds, part and label; thresholds by statistic.

    A threshold lies in the middle between the values that it parts.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    share = min(1.0, max_labelled / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = with_counts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    sample = written(
        sample.select(
            *[c.alias(name) for name, c in _statistics().items()],
            (F.col("quality") == 0).cast("int").alias("bad"),
            (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        ),
        "labelled",
    )
    steps = [i / quantiles for i in range(1, quantiles)]
    cuts = sample.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in STATISTICS]).first()
    thresholds = {c: sorted(set(cuts[c] or [])) for c in STATISTICS}
    # One array of thresholds for each statistic: as many comparisons spelt out take longer to compile than to run.
    place = lambda c: F.size(F.filter(F.array(*map(F.lit, thresholds[c])).cast("array<double>"), lambda t: F.col(c) > t))
    placed = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), place(c).alias("place"), F.col(c).alias("value")) for c in STATISTICS])).alias("p")
    ranges = sample.select(placed).groupBy("p.name", "p.place").agg(F.min("p.value").alias("low"), F.max("p.value").alias("high")).collect()
    middles = {}
    for c, cuts_of in thresholds.items():
        middles[c] = []
        for k, cut in enumerate(cuts_of):
            below, above = [r["high"] for r in ranges if r["name"] == c and r["place"] <= k], [r["low"] for r in ranges if r["name"] == c and r["place"] > k]
            middles[c].append((max(below) + min(above)) / 2 if below and above else cut)
    cells = sample.select(*[place(c).alias(c) for c in STATISTICS], "prune", "bad").groupBy(*STATISTICS, "prune").agg(F.sum("bad").alias("bad"), F.count("*").alias("all"))
    return [(tuple(r[c] for c in STATISTICS), r["prune"], r["bad"], r["all"] - r["bad"]) for r in cells.collect()], middles


def _holds(cell: tuple, tests: list[tuple[int, bool, int]]) -> bool:
    return all((cell[s] > cut) == above for s, above, cut in tests)


def _totals(cells: list, tests: list[tuple[int, bool, int]]) -> tuple[int, int]:
    covered = [(b, g) for cell, _, b, g in cells if _holds(cell, tests)]
    return sum(b for b, _ in covered), sum(g for _, g in covered)


def _grow(cells: list, thresholds: dict[str, list[float]], max_tests: int) -> list[tuple[int, bool, int]]:
    """Tests ``(statistic, above, cut)`` by greatest information gain, until none gains."""
    tests: list[tuple[int, bool, int]] = []
    while len(tests) < max_tests:
        bad, good = _totals(cells, [])
        if not bad or not good:
            break
        before, best = math.log2(bad / (bad + good)), (0.0, None)
        for s, name in enumerate(STATISTICS):
            by_place = [[0, 0] for _ in range(len(thresholds[name]) + 1)]
            for cell, _, b, g in cells:
                by_place[cell[s]][0] += b
                by_place[cell[s]][1] += g
            low_b = low_g = 0
            for cut in range(len(thresholds[name])):
                low_b, low_g = low_b + by_place[cut][0], low_g + by_place[cut][1]
                for above, b, g in ((False, low_b, low_g), (True, bad - low_b, good - low_g)):
                    if b and b + g < bad + good:
                        gain = b * (math.log2(b / (b + g)) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, (s, above, cut))
        if best[1] is None:
            break
        tests.append(best[1])
        cells = [c for c in cells if _holds(c[0], tests[-1:])]
    return tests


def learn_rules(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, quantiles: int = 40, max_rules: int = 12, max_tests: int = 3, least_precision: float = 0.75, least_covered: int = 5
) -> list[Rule]:
    """Learn rejecting rules from ``labels(doc_id, quality)``; quality 0 is to be rejected."""
    cells, thresholds = _labelled_counts(docs, labels, max_labelled, quantiles)
    growing, pruning = [c for c in cells if not c[1]], [c for c in cells if c[1]]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        tests = _grow(growing, thresholds, max_tests)
        if not tests:
            break

        def worth(some: list[tuple[int, bool, int]]) -> float:
            bad, good = _totals(pruning, some)
            return (bad - good) / (bad + good) if bad + good else -1.0

        tests = max((tests[:n] for n in range(len(tests), 0, -1)), key=worth)  # the longest of equals
        bad, good = (sum(x) for x in zip(_totals(growing, tests), _totals(pruning, tests), strict=True))
        if bad < least_covered or bad < least_precision * (bad + good):
            break
        rules.append(tuple(Test(STATISTICS[s], above, thresholds[STATISTICS[s]][cut]) for s, above, cut in tests))
        growing, pruning = ([c for c in part if not _holds(c[0], tests)] for part in (growing, pruning))
    return rules


def decision(rules: list[Rule]) -> Column:
    """The ordered conditional: text of the first rule that holds, else null."""
    verdict = None
    for rule in rules:
        met = rule[0].column()
        for test in rule[1:]:
            met = met & test.column()
        name = F.lit(" and ".join(map(str, rule)))
        verdict = F.when(met, name) if verdict is None else verdict.when(met, name)
    return (F.lit(None) if verdict is None else verdict).cast("string")


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``rule`` (that rejects, or null) and ``kept``."""
    counted = with_counts(docs)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counted.withColumn("base_failed", failed).withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the base test and the rules keep, with their own columns."""
    rows = docs.select(packed(docs).alias("given"), F.col("text"))
    return judged(rows, rules).filter("kept").select("given.*")
