"""Connected components by alternating stars, on tables cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Links each node's larger (large star) or smaller (small star) neighbours, and itself, to the least of its neighbours and itself.

    The least neighbours are a table of their own, so that a node with many neighbours is a key that a join can split.
    Also returns that table.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    joined = both.join(least, "u")
    out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """The columns node and root, for every node of ``edges`` (a long, b long); the root is the component's least node.

    Repeated edges, loops and an empty table do no harm. The number of rounds grows with the logarithm of the number
    of nodes; a node with many neighbours costs one row a neighbour, combined in each task before the shuffle.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        stars = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if stars == mark or not stars.n:
            break
        mark, before = stars, now
        half, first = _star(now, large=True)
        half = cut(half, "cc")
        whole, second = _star(half, large=False)
        now = cut(whole, "cc")
        discard(before, half, first, second)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
