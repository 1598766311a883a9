"""Exact vector search and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """vec_id, distance (1 - cosine) of the k nearest; filters come before ranking; zero vectors rank last."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = vectors if where is None else vectors.where(where)
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding"))) * float(sum(x * x for x in query) ** 0.5)
    d = 1 - _dot(F.col("embedding"), q) / F.when(norm > 0, norm)
    return v.select("vec_id", d.alias("distance")).orderBy(F.asc_nulls_last("distance"), "vec_id").limit(k)


def fused(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of bounded ranked lists (key, rank): score = sum of 1 / (k + rank)."""
    every = lists[0].select(key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def ranked(top: DataFrame, key: str, *order: Column) -> DataFrame:
    """1-based rank within an already limited list."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order, key)))
