"""Ranks and predecessors within large groups, without holding a group in one task.

A group is cut into blocks of an ordered key. A block is sorted by itself; what it needs from earlier
blocks comes from one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """Adds the row's number in its group, from 0. ``block`` must not decrease along ``order``."""
    b = df.withColumn("_block", block)
    before = b.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return b.withColumn("_row", F.row_number().over(inside) - 1).join(before, [*keys, "_block"]).withColumn(name, (F.col("_row") + F.col("_ahead")).cast("bigint")).drop("_block", "_row", "_ahead")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the group's rows up to and with this one."""
    b = df.withColumn("_block", block)
    before = b.groupBy(*keys, "_block").agg(F.sum(value).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.withColumn("_own", F.sum(value).over(inside)).join(before, [*keys, "_block"]).withColumn(name, F.col("_own") + F.col("_ahead")).drop("_block", "_own", "_ahead")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """Adds ``value`` of the row before in the group; null at its first row."""
    b = df.withColumn("_block", block)
    last = b.groupBy(*keys, "_block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return b.withColumns({"_first": F.row_number().over(inside) == 1, "_lag": F.lag(value).over(inside)}).join(last, [*keys, "_block"]).withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_block", "_first", "_lag", "_carried")
