"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


#: From so many edges on, minima are written before edges are joined with them.
MANY = 1 << 22


def _hung(edges: DataFrame, many: bool) -> tuple[DataFrame, DataFrame]:
    """Every edge ``(u, v)`` with the least node ``m`` that ``u`` sees or is, and the table of minima.

    Written minima let Spark split the edges of a hub; for few edges a job more costs more than a hub.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = written(least, "minima") if many else least
    return edges.join(least, "u"), least


def connected_components(edges: DataFrame) -> DataFrame:
    """Map every node of ``edges(u, v)`` to the least node it reaches.

    Each step hangs neighbours on the least node they see, so paths shrink
    geometrically and edges never multiply. Every step is a written table.
    Self-loops and repeated edges are allowed; the result is ``(node,
    component)`` with one row per node, and empty for no edges.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    many, seen = edges.count() > MANY, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung, first = _hung(both, many)
        large = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges") if many else large
        loops = edges.filter("u = v")
        moved = F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("v", "u")])
        hung, second = _hung(large, many)
        small = hung.select(F.explode(moved).alias("edge")).select("edge.*").filter("u <> v")
        after = written(small.unionByName(loops).distinct(), "edges")
        discard(edges, first, large, second)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots).distinct().groupBy("node").agg(F.min("component").alias("component"))
