"""Near-duplicate groups by MinHash with tensored banding.

Two documents are linked if the Jaccard similarity of their word-shingle sets
reaches a threshold; groups are the connected components of all links.

Method. Two small collections of t bands each (a band hashes ``rows`` minhashes)
stand for t * t tables: table (i, j) is keyed by band i of the first and band j
of the second collection. That needs 2 * t * rows minhashes instead of
2 * t * t * rows. A pair at the threshold is missed only if all bands of one
collection differ; t is the least number that misses at most ``miss`` of such
pairs (10 at 0.85, 13 at 0.80), and far fewer above it.

Scale. Equal sets count as one class from the start, so exact copies never
meet in a bucket. A document whose bands of either collection match nobody is
dropped before tables are formed, without loss. Buckets do not emit all pairs:

1. Every member is compared with its buckets' leaders, the members with most
   company, so a bucket of edited copies is led by the text most like all.
2. Components of the confirmed links are formed. Let D be the shingles in which
   a member differs from its leader. If a member is not linked with the leader
   then it can only be linked with members that share part of its D, and so
   many that a shared element lies among the ``(1 - J) / J * size + 1`` rarest of
   both. Members that share such an element form a group. As long as groups
   have many pairs across components, one member of each, its head, is compared
   with the others and components are formed anew; then every pair of a group
   that lies across components is compared. Pairs within a component, however
   large it is, are never formed: they can join nothing.

All links are confirmed on full sets built from whole texts.

Defined cases: texts shorter than a shingle are one shingle of all their words;
null and empty texts have an empty set and are linked with nothing; equal rows
fall into one class; rows that share a ``doc_id`` are one node of the graph,
linked with all that any of their texts is linked with; rows without a ``doc_id``
are linked with nothing, have a null component and are not kept; there are no
ties, since the least ``doc_id`` names a group; a text of any length is read whole,
in one task; extra columns, whatever their names, are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .expressions import packed
from .storage import discard, written
from .tokens import Words, mix, span_hashes, text_slices, windows


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text and hash, and their text."""
    hashes = words.hashes()
    start, text = windows(words, width)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    start = np.concatenate([start, words.first[short]])
    end = start + width
    end[len(end) - len(short) :] = words.first[short + 1]
    text = np.concatenate([text, short])
    found = span_hashes(hashes, start, end)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[fresh], text[fresh]


def _signatures(width: int, tables: int, rows: int):
    factors = mix(np.arange(1, 2 * tables * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column("text")):
                found, text = _shingles(Words(data, offsets, lower=True), width)
                sizes = np.bincount(text, minlength=end - row)
                full = np.flatnonzero(sizes)
                heads = np.searchsorted(text, full)
                prints, bands = np.zeros((2, end - row), dtype=np.uint64), np.zeros((end - row, 2 * tables), dtype=np.uint64)
                if len(full):
                    other = mix(found ^ np.uint64(0x5851F42D4C957F2D))
                    prints[0, full], prints[1, full] = np.add.reduceat(found, heads), np.add.reduceat(other, heads)
                    for band in range(2 * tables):
                        code = np.full(len(full), band + 1, dtype=np.uint64)
                        for factor in factors[band * rows : (band + 1) * rows]:
                            values = found * factor
                            values ^= values >> np.uint64(32)
                            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values * factor, heads))
                        bands[full, band] = code
                size = 2 * tables
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, size * (end - row) + 1, size, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return run


def _compare(width: int, differences: bool):
    """Sizes of ``text_x``'s set, of intersection and union, and on request what differs."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_slices(column):
            found, text = _shingles(Words(data, offsets, lower=True), width)
            bounds = np.searchsorted(text, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                yield found[bounds[i] : bounds[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, len(whole), 1024)):
            own, both, total, differ = [], [], [], []
            for a, b in zip(sets(batch.column("text_x")), sets(batch.column("text_y")), strict=True):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                own.append(len(a))
                both.append(shared)
                total.append(len(a) + len(b) - shared)
                differ.append(np.setxor1d(a, b, assume_unique=True).view(np.int64) if differences else None)
            numbers = [pa.array(c, pa.int64()) for c in (own, both, total)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *numbers, pa.array(differ, pa.list_(pa.int64()))], names=["x", "y", "size", "shared", "total", "differ"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, differences: bool = False) -> DataFrame:
    left = texts.select(F.col("node").alias("x"), F.col("text").alias("text_x"))
    right = texts.select(F.col("node").alias("y"), F.col("text").alias("text_y"))
    joined = pairs.select("x", "y").join(right, "y").join(left, "x").select("x", "y", "text_x", "text_y")
    return joined.mapInArrow(_compare(width, differences), "x long, y long, size long, shared long, total long, differ array<long>")


def _buckets(classes: DataFrame, tables: int) -> tuple[DataFrame, DataFrame]:
    """``(key, node)`` of all tables that a class may share with another class, and the table of shared bands."""
    bands = classes.select("node", F.posexplode("bands").alias("band", "code")).withColumn("key", F.xxhash64("band", "code"))
    common = written(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "common-bands")
    useful = bands.join(common, "key", "left_semi").groupBy("node").agg(F.collect_list(F.struct("band", "key")).alias("own"))
    first = F.filter("own", lambda b: b["band"] < tables)
    second = F.filter("own", lambda b: b["band"] >= tables)
    keys = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x["key"], y["key"]))))
    return useful.select(F.col("node"), first.alias("a"), second.alias("b")).select("node", F.explode(keys).alias("key")), common


def _placed(rows: DataFrame, parts: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of ``node``, its own where it has no link."""
    named = parts.select(F.col("node").alias(node), F.col("component").alias("found"))
    return rows.join(named, node, "left").withColumn(name, F.coalesce("found", node)).drop("found")


def _rare(tested: DataFrame, parts: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members of a leader ``y`` by the rare shingles in which they differ from it, and the tables used.

    Only leaders with members in several components count, and only shingles that
    more than one member has.
    """
    placed = _placed(_placed(tested.drop("differ"), parts, "x", "part"), parts, "y", "main")
    split = placed.groupBy("y").agg(F.min(F.least("part", "main")).alias("low"), F.max(F.greatest("part", "main")).alias("high"))
    split = written(split.filter("low < high").select("y"), "split")
    facts = written(placed.join(split, "y", "left_semi").select("x", "y", "linked", "size", (F.col("shared") / F.col("total")).alias("alike")), "members")
    apart = tested.join(split, "y", "left_semi").select("x", "y", F.size("differ").alias("n"), F.explode("differ").alias("shingle"))
    twice = written(apart.groupBy("y", "shingle").agg(F.count("*").alias("times")).filter("times > 1"), "shared-differences")
    common = apart.join(twice, ["y", "shingle"])
    mine = Window.partitionBy("x", "y")
    common = common.withColumn("common", F.count("*").over(mine))
    ranked = common.withColumn("rank", F.row_number().over(mine.orderBy("times", "shingle")) + F.col("n") - F.col("common"))
    rare = ranked.join(facts, ["x", "y"]).filter(F.col("rank") <= F.floor(F.col("size") * (100 - percent) / percent) + 1)
    return written(rare.select("y", "shingle", "linked", *_FACTS), "rare"), [split, facts, twice]


_FACTS = ["x", "size", "alike", "n", "common"]


def _reachable(percent: int) -> Column:
    """Whether the facts of two members of a leader allow a link between them."""
    # Linked sets differ in few shingles, so what each adds to the leader must mostly be common.
    needed = (F.col("n") + F.col("n_2") - (F.col("size") + F.col("size_2")) * (100 - percent) / (100 + percent)) / 2
    return (
        (F.least("size", "size_2") * 100 >= F.greatest("size", "size_2") * percent)
        & (F.abs(F.col("alike") - F.col("alike_2")) <= 1 - percent / 100 + 1e-9)
        & (F.least("common", "common_2") >= needed - 1e-6)
    )


def _mixed_groups(rare: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``rare`` whose leader and shingle have members of several components, and these pairs of both."""
    placed = _placed(rare, parts, "x", "part")
    groups = placed.groupBy("y", "shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct("linked", "x")).alias("head"))
    groups = written(groups.filter("low < high AND NOT head.linked").select("y", "shingle", F.col("head.x").alias("head")), "mixed-groups")
    return written(placed.join(groups.drop("head"), ["y", "shingle"]), "mixed"), groups


def _against_heads(mixed: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of each group's members with its head, a member that is not linked with the leader."""
    heads = mixed.select("y", "shingle", "part", *_FACTS).join(groups.withColumnRenamed("head", "x"), ["y", "shingle", "x"])
    heads = heads.select("y", "shingle", *[F.col(c).alias(f"{c}_2") for c in ("part", *_FACTS)])
    met = mixed.join(written(heads, "heads"), ["y", "shingle"]).filter(F.col("part") != F.col("part_2")).filter(_reachable(percent))
    return met.select(F.greatest("x", "x_2").alias("x"), F.least("x", "x_2").alias("y")).distinct()


def _meetings(mixed: DataFrame, percent: int) -> tuple[DataFrame, float]:
    """Parts of a group of which members may be linked, and how many pairs of members these are.

    A part is judged by the extremes of its members' facts, so none is lost.
    """
    surplus = F.col("n") - F.col("size") * (100 - percent) / (100 + percent)
    facts = [F.min("size").alias("least"), F.max("size").alias("most"), F.min("alike").alias("far"), F.max("alike").alias("near"), F.min(surplus).alias("surplus"), F.max("common").alias("common")]
    of_part = written(mixed.groupBy("y", "shingle", "part").agg(F.count("*").alias("all"), F.sum((~F.col("linked")).cast("int")).alias("strays"), *facts), "parts-of-groups")
    other = of_part.filter("strays > 0").select("y", "shingle", *[F.col(c).alias(f"{c}_2") for c in of_part.columns[2:]])
    possible = (
        (F.col("part") != F.col("part_2"))
        & (F.col("most") * 100 >= F.col("least_2") * percent)
        & (F.col("most_2") * 100 >= F.col("least") * percent)
        & (F.greatest(F.col("far") - F.col("near_2"), F.col("far_2") - F.col("near")) <= 1 - percent / 100 + 1e-9)
        & (F.least("common", "common_2") >= (F.col("surplus") + F.col("surplus_2")) / 2 - 1e-6)
    )
    met = written(of_part.join(other, ["y", "shingle"]).filter(possible).select("y", "shingle", "part", "part_2", (F.col("all") * F.col("strays_2")).alias("pairs")), "meetings")
    discard(of_part)
    return met, float(met.agg(F.sum("pairs")).first()[0] or 0)


def _across(mixed: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components; pairs of one component are never formed."""
    stray = mixed.filter("NOT linked").select("y", "shingle", *[F.col(c).alias(f"{c}_2") for c in ("part", *_FACTS)])
    # Strays meet parts before they meet members, so that only pairs which may be linked are formed.
    pairs = mixed.join(stray.join(met, ["y", "shingle", "part_2"]), ["y", "shingle", "part"]).filter(_reachable(percent))
    return pairs.select(F.greatest("x", "x_2").alias("x"), F.least("x", "x_2").alias("y")).distinct()


def _links(confirmed: DataFrame, percent: int) -> DataFrame:
    near = F.col("shared") * 100 >= F.col("total") * percent
    return confirmed.filter(near).select(F.col("x").alias("u"), F.col("y").alias("v"))


def tables_for(percent: int, rows: int, miss: float) -> int:
    """Bands of ``rows`` minhashes in each collection that miss at most ``miss`` of the pairs at the threshold."""
    alike = (percent / 100) ** rows
    return math.ceil(math.log(miss / 2) / math.log(1 - alike)) if alike < 1 else 1


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 2e-4, rows: int = 3) -> DataFrame:
    """Return ``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the least ``doc_id`` of the group and ``kept`` marks it.
    Documents are linked if ``100 * intersection >= percent * union``.
    """
    tables = tables_for(percent, rows, miss)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = written(base.mapInArrow(_signatures(width, tables, rows), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "signatures")

    filled = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    buckets, common = _buckets(classes, tables)
    crowded = buckets.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    crowded = written(crowded, "crowded")  # a plain side, so that Spark can split a skewed bucket
    members = written(buckets.join(crowded, "key"), "buckets")
    company = members.groupBy("node").agg(F.sum("members").alias("company"))
    leaders = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", -F.col("node"))).alias("most"))
    leaders = written(leaders.select("key", (-F.col("most.col2")).alias("leader")), "leaders")
    stars = members.join(leaders, "key").filter("node <> leader").select(F.col("node").alias("x"), F.col("leader").alias("y")).distinct()

    involved = members.select("node").distinct()
    texts = base.select(F.col("doc_id").alias("node"), "text").join(involved, "node", "left_semi")
    texts = written(texts.withColumn("hash", F.xxhash64("text")).dropDuplicates(["node", "hash"]).drop("hash"), "texts")
    near = F.col("shared") * 100 >= F.col("total") * percent
    tested = written(_confirmed(stars, texts, width, differences=True).withColumn("linked", near), "tested")

    # Several texts of one doc_id are one node: it joins the classes of all of them.
    edge = ("f1", "f2")
    several = filled.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in edge for f in (F.min, F.max)]).filter("min_f1 < max_f1 OR min_f2 < max_f2")
    same = filled.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    links = written(tested.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(same.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))), "links")
    parts = written(connected_components(links), "parts")
    rare, used = _rare(tested, parts, percent)

    # Groups that hold several components get a head, with which all others are compared, as long as the
    # pairs across components are many and grow fewer; then each pair across components is compared.
    mixed, groups = _mixed_groups(rare, parts)
    met, pairs = _meetings(mixed, percent)
    before = math.inf
    while 16 * mixed.count() < pairs < 0.9 * before:
        more = written(_links(_confirmed(_against_heads(mixed, groups, percent), texts, width), percent), "links")
        links, old = written(links.unionByName(more), "links"), links
        discard(old, more, mixed, groups, parts, met)
        parts = written(connected_components(links), "parts")
        mixed, groups = _mixed_groups(rare, parts)
        before, (met, pairs) = pairs, _meetings(mixed, percent)
    more = _links(_confirmed(_across(mixed, met, percent), texts, width), percent)
    merged = connected_components(links.unionByName(more))

    found = written(classes.join(merged, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component")), "found")
    discard(classes, common, crowded, members, leaders, texts, tested, links, parts, rare, mixed, groups, met, *used)
    full = filled.select("doc_id", "n_shingles", "f1", "f2").join(found, ["f1", "f2"]).drop("f1", "f2")
    alone = marks.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False))
    return full.unionByName(alone).select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 2e-4, rows: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, and every row with an empty set.

    Rows are told apart by a hash of ``doc_id`` and text, so a null ``doc_id`` or one
    that several texts share is a row like any other. The row with the least
    ``doc_id`` of a group stays, then that with the least hash; a null ``doc_id`` comes
    last. Of rows equal in ``doc_id`` and text one stays.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.xxhash64(doc_id, text)
    groups = near_duplicates(docs.select(key.alias("doc_id"), text.alias("text")), width, percent, miss, rows)
    groups = groups.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    members = docs.select(key.alias("row_key"), doc_id.alias("own_id")).distinct().join(groups, "row_key")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("missing"), "own_id", "row_key")).alias("least"))
    kept = written(least.select(F.col("least.row_key").alias("row_key")), "kept-rows")
    given = docs.select(packed(docs).alias("given"), key.alias("row_key")).join(kept, "row_key", "left_semi")
    # Equal rows meet in each task before they meet in one.
    return given.groupBy("row_key").agg(F.first("given").alias("given")).select("given.*")
