"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. On each level
every child draws ``-ln(u) / weight`` from a hash of the row's ``doc_id`` and the
child's name, and the least draw wins, so a child gets rows in proportion to
its weight. If weights change below one node, rows move only into or out of
the subtrees whose weights changed. :func:`grown` adds a shard in a region of its
own, so that no other weight changes and rows move into the new shard alone.

``slot`` numbers the rows of each shard without gaps. It is a count within a
hash bucket plus the counts of the buckets before it, so no shard is ordered in
one task.

Defined cases: a null text has size 8 and checksum 0; a null ``doc_id`` is placed
as if it were the empty string; equal draws go to the child with the least number;
repeated rows share a shard and get slots of their own; slots of equal places go
by ``doc_id``, checksum and size; a text of any length only counts by its bytes;
extra columns are ignored, and :func:`sharded` keeps them; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import draw, making_room
from .storage import written

#: (region, rack, shard, weight) of each leaf.
Tree = list[tuple[int, int, int, float]]
SLOT_BUCKETS = 512


def even_tree(shards: int, per_rack: int = 4, per_region: int = 8) -> Tree:
    """Equal shards, numbered from 0, in racks and regions of fixed size."""
    return [(s // per_region, s // per_rack, s, 1.0) for s in range(shards)]


def grown(tree: Tree) -> Tree:
    """The tree with one more shard of mean weight, in a region of its own."""
    region, rack, shard = (max(leaf[i] for leaf in tree) + 1 for i in range(3))
    return [*tree, (region, rack, shard, sum(leaf[3] for leaf in tree) / len(tree))]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that ``key`` descends to."""

    def choose(leaves: Tree, level: int) -> Column:
        if level == 3:
            return F.lit(leaves[0][2])
        children = sorted({leaf[level] for leaf in leaves})
        below = {c: [leaf for leaf in leaves if leaf[level] == c] for c in children}
        if len(children) == 1:
            return choose(below[children[0]], level + 1)
        draws = [F.struct((-F.ln(draw(F.lit(f"{level}/{c}"), key)) / sum(leaf[3] for leaf in below[c])).alias("draw"), F.lit(c).alias("child")) for c in children]
        winner = F.array_min(F.array(*draws))["child"]
        if level == 2:
            return winner
        picked = None
        for c in children:
            one = choose(below[c], level + 1)
            picked = F.when(winner == c, one) if picked is None else picked.when(winner == c, one)
        return picked

    return choose(tree, 0).cast("int")


def _row_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def shard_rows(docs: DataFrame, tree: Tree) -> DataFrame:
    """Return ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(_row_key(), tree).alias("shard"),
        shard_of(_row_key(), grown(tree)).alias("grown_shard"),
        F.xxhash64(_row_key(), F.lit("slot")).alias("place"),
    ).withColumn("bucket", F.pmod(F.xxhash64("place", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int"))
    placed = written(placed, "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "text_crc32", "size")
    numbered = placed.withColumn("number", F.row_number().over(within)).join(offsets, ["shard", "bucket"])
    slot = (F.col("offset") + F.col("number") - 1).cast("long")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def sharded(docs: DataFrame, tree: Tree) -> DataFrame:
    """The rows of ``docs`` with their ``shard``; a column of that name becomes ``given_shard``."""
    return making_room(docs, "shard").withColumn("shard", shard_of(_row_key(), tree))
