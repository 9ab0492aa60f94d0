"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketlens.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u")
    return (tied.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node of the component.

    ``edges``: two long columns a, b without NULLs, a <> b; direction and repeats do not matter. Both
    steps are joins and minimum aggregates on node ids, so a node with very many neighbours is combined
    before the shuffle. The number of rounds grows with the logarithm of the longest path. Each round is
    written to the checkpoint folder, so a lost executor costs no more than the current round. An
    empty table gives an empty table.
    """
    now, seen = cut_lineage(edges.select("a", "b").distinct()), None
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(row)
