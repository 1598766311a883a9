"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.shared import forget, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Joins every neighbour (the larger ones, or the smaller ones) of a node to the least node around it."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    kept = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return kept.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, a: str, b: str, folder: str | None = None, rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link. Links may come in any order and more than once.

    Rounds needed grow with the logarithm of the nodes; if ``rounds`` were not enough, an error says so. The result reads a table in ``folder``.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges, before = written(edges, "edges", folder), None
    for _ in range(rounds):
        new = written(_stars(_stars(edges, True), False), "edges", folder)
        forget(edges)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components are not settled after {rounds} rounds")
