"""Running sums in groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.files import Scratch


def running(df: DataFrame, group: str, order: list[Column], value: str, name: str, scratch: Scratch) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come before in ``order``, which must tell rows apart.

    Rows are sorted into ranges over tasks and summed there; a group that lies over several ranges gets the sums of the
    ranges before added, and there are at most as many such pieces as twice the ranges.
    """
    placed = df.repartitionByRange(F.col(group), *order).withColumn("_p", F.spark_partition_id())
    placed = scratch.written(placed, "ranges")
    inside = Window.partitionBy("_p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(group, "_p").agg(F.sum(value).alias("_sum"))
    several = pieces.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(group)
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.join(F.broadcast(several), group).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(group, "_p", "_before")
    out = placed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(F.broadcast(offsets), [group, "_p"], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_p", "_before")
