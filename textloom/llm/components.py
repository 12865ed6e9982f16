"""Connected components on the cluster, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node it reaches.

    Each round links every node's larger neighbours to its smallest one, then its
    smaller ones, until nothing changes; links are never gathered anywhere, and
    each round is written to the shared folder.  Nodes compare as values of their
    type.  Links of a node with itself and repeated links change nothing.
    """
    now = kept(links.filter("a <> b").select("a", "b").distinct(), "links")
    state = _state(now)
    while True:
        now = kept(_small_star(_large_star(now)), "links")
        after = _state(now)
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        state = after


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
