"""Mixing sources to target weights by weighted fair queueing.

Each source has a target number of words. Its documents queue in a shuffled
order that depends on ``doc_id`` (and text) alone, up to ``passes`` times over. A document's
virtual finish time is the source's words up to and with it, divided by the
target; documents of all sources are sorted by it and taken until the total
budget is reached. Sources then stand near their targets wherever one stops.

Targets. Sources by code point, null last, weigh 3, 1, 2, repeating. They share
``share`` times all words by weight; a target stops at ``passes`` times its
source's words and the excess goes to the others, until none is above.

Scale. Nothing is sorted in one place: running totals are sums within hash (or
virtual-time) buckets plus the totals of the buckets before them, a table of
bounded size. A source with most rows spreads over ``BUCKETS`` tasks. Only the
table of sources itself, one row each, is ordered as a whole.

Defined cases: null and empty texts have size 0 and are never taken; a null
source is a source; a null ``doc_id`` queues by its text; equal virtual
times go by source, pass, place and text, so reruns agree; rows
repeated as a whole queue one by one, and :func:`mixed` shares their copies
evenly; a text of any length counts whole and is taken whole; extra columns, whatever their
names, are kept by :func:`mixed` and otherwise ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import SPACES, packed, words
from .storage import discard, written

BUCKETS = 4096
SOURCE = ["no_source", "source_key"]


PLACE = ["shuffle", "text_key"]  # the order of a source's documents


def _shuffle() -> Column:
    text = F.col("text").cast("string")
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")), F.lit("")), F.lit("|mix")).cast("binary")).alias("shuffle")


def _keys() -> list[Column]:
    """Source and place in the shuffle of a document."""
    text = F.col("text").cast("string")
    return [
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        F.xxhash64(text).alias("text_key"),
        _shuffle(),
    ]


def _sized(docs: DataFrame) -> DataFrame:
    """One row for each document."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.size(words(F.col("text"))).cast("long").alias("size"), *_keys())


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), passes: int = 2) -> DataFrame:
    """Targets of ``(no_source, source_key, source_size)`` rows, by water-filling.

    Sources in order of cap over weight: one is capped if even the level at
    which it alone just fills exceeds what is left for those after it.
    All comparisons are of whole numbers.
    """
    number = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long"))
    up, down = share
    order = Window.orderBy(F.col("source_size") / F.col("weight"), *SOURCE)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    everything = Window.partitionBy()
    levels = ranked.select(
        "*",
        F.sum(wide("weight")).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.coalesce(F.sum(wide("source_size") * passes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum(wide("source_size")).over(everything).alias("total"),
    )
    full = F.col("source_size") * passes * F.col("rest") * down + F.col("before") * F.col("weight") * down <= F.col("total") * F.col("weight") * up
    capped = levels.withColumn("capped", full)
    taken = capped.select(
        "*",
        F.sum(F.when(F.col("capped"), wide("source_size") * passes).otherwise(0)).over(everything).alias("held"),
        F.sum(F.when(~F.col("capped"), wide("weight")).otherwise(0)).over(everything).alias("open"),
    )
    shared = (F.col("weight") * (F.col("total") * up - F.col("held") * down)).cast("double") / (F.col("open") * down).cast("double")
    target = F.when(F.col("capped"), (F.col("source_size") * passes).cast("double")).otherwise(shared)
    budget = F.col("total").cast("double") * up / down
    return taken.select(*SOURCE, "source_size", target.alias("target"), budget.alias("budget"))


def _queue(sized: DataFrame, weights: tuple[int, ...], share: tuple[int, int], passes: int) -> tuple[DataFrame, DataFrame]:
    """``(targets, served)``: every row's passes through the queue, and whether the mix takes them."""
    sizes = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, passes), "targets")

    queued = sized.filter("size > 0").withColumn("bucket", F.conv(F.substring("shuffle", 1, 3), 16, 10).cast("int"))
    by_bucket = queued.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(*SOURCE, "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*SOURCE, "bucket").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    placed = queued.withColumn("running", F.sum("size").over(within)).join(offsets, [*SOURCE, "bucket"]).join(targets, SOURCE)

    passed = placed.withColumn("pass", F.explode(F.array(*map(F.lit, range(passes)))))
    finish = (F.col("pass") * F.col("source_size") + F.col("offset") + F.col("running")).cast("double") / F.col("target")
    passed = passed.withColumn("finish", finish)
    # Fine steps up to virtual time 2, then steps of a fixed ratio: at most 25,000 buckets.
    step = F.when(F.col("finish") < 2, F.floor(F.col("finish") * BUCKETS)).otherwise(2 * BUCKETS + F.floor(F.log2("finish") * 256)).cast("int")
    timed = written(passed.select("row", *SOURCE, "size", *PLACE, "pass", "finish", "budget", step.alias("step")), "queue")
    ahead = timed.groupBy("step").agg(F.sum("size").alias("words"))
    ahead = ahead.select("step", F.coalesce(F.sum("words").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    line = Window.partitionBy("step").orderBy("finish", *SOURCE, "pass", *PLACE).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("ahead") + F.sum("size").over(line)
    served = timed.join(F.broadcast(ahead), "step").select("row", *SOURCE, "size", *PLACE, "pass", (total <= F.col("budget")).alias("taken"))
    served = written(served, "served")
    discard(timed)
    return targets, served


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), passes: int = 2) -> DataFrame:
    """Return ``doc_id, size, source_size, target, taken, source, copies`` for every row."""
    sized = written(_sized(docs), "sized")
    targets, served = _queue(sized, weights, share, passes)
    taken = served.groupBy("row").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
    # A row without words is not queued; it needs no match, so it keeps out of the join.
    full = sized.filter("size > 0").join(taken, "row", "left")
    rows = full.unionByName(sized.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return rows.join(targets.drop("budget"), SOURCE).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.col("taken").cast("long").alias("taken"),
        F.when(F.col("no_source"), F.lit(None)).otherwise(F.col("source_key")).alias("source"),
        F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int").alias("copies"),
        "text_key",
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), passes: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    In each pass the mix takes a source's documents up to some place of their
    order, so a row's copies follow from its place and the last ones of its source,
    and no text moves. Only rows at a last place itself are counted.
    """
    sized = written(_sized(docs), "sized")
    _, served = _queue(sized, weights, share, passes)
    place = F.struct(*PLACE)
    ends = [f"end_{p}" for p in range(passes)]
    last = served.filter("taken").groupBy(*SOURCE).agg(*[F.max(F.when(F.col("pass") == p, place)).alias(end) for p, end in enumerate(ends)])
    last = written(last, "last-places")
    discard(sized)
    at_end = reduce(Column.__or__, [F.coalesce(place == F.col(end), F.lit(False)) for end in ends])
    before = sum((F.coalesce(place < F.col(end), F.lit(False)).cast("int") for end in ends), F.lit(0))
    filled = F.btrim(F.col("text").cast("string"), F.lit(SPACES)) != ""
    keyed = docs.filter(filled).select(packed(docs).alias("given"), *_keys()).join(last, SOURCE)
    plain = keyed.filter(~at_end).select("given", before.alias("times"))

    # Rows at one place are equal in doc_id and text. They are counted by what else they hold, in each task first, and
    # share their copies evenly, the rest going to the first.
    counts = served.join(last, SOURCE).filter(at_end).groupBy(*SOURCE, *PLACE)
    counts = counts.agg(F.sum((F.col("pass") == 0).cast("long")).alias("rows"), F.sum(F.col("taken").cast("long")).alias("copies"))
    found = last.select(F.explode(F.array(*[F.col(f"{end}.shuffle") for end in ends])).alias("shuffle")).filter("shuffle IS NOT NULL").distinct()
    near = docs.filter(filled).select(packed(docs).alias("given"), "doc_id", "text", "source", _shuffle()).join(found, "shuffle", "left_semi").select("given", *_keys())
    several = near.join(last, SOURCE).filter(at_end).withColumn("kind", F.xxhash64(F.to_json("given")))
    several = several.groupBy(*SOURCE, *PLACE, "kind").agg(F.count("*").alias("n"), F.first("given").alias("given")).join(written(counts, "at-last-places"), [*SOURCE, *PLACE])
    earlier = Window.partitionBy(*SOURCE, *PLACE).orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.greatest(F.lit(0), F.least(F.col("n"), F.col("copies") % F.col("rows") - F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    several = several.select("given", (F.col("n") * F.expr("copies div rows") + rest).cast("int").alias("times"))
    discard(served)
    every = plain.unionByName(several).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return every.select("given.*")
