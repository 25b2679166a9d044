"""Ordered computations over groups of any size.

A window over a whole group puts its rows in one task. Here a group is cut into blocks by a column that grows with the order
(a day, a range of ids); a block is summed up in one row, the sums are carried along the blocks of the group, and rows see
their own block and what was carried into it. Rows are shuffled once, by group and block. Null groups are a group, null blocks a block
that comes first, as nulls do in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(df: DataFrame, group: list[str], block: str, summary: Column, carry, backward: bool = False) -> DataFrame:
    """``df`` with ``__carry``: ``carry`` (a function of a window over the blocks of a group) of the blocks' summaries."""
    sums = df.groupBy(*group, block).agg(summary.alias("__sum"))
    along = Window.partitionBy(*group).orderBy(F.col(block).desc() if backward else F.col(block).asc())
    return _same(df, sums.select(*group, block, carry(along).alias("__carry")), [*group, block])


def _same(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the further columns of ``other`` by equal keys; nulls are equal, as in a window's partitions."""
    named = other.select(*(F.col(k).alias(f"__key{n}") for n, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    on = F.lit(True)
    for n, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__key{n}"))
    return df.join(named, on).drop(*(f"__key{n}" for n in range(len(keys))))


def with_previous(df: DataFrame, group: list[str], order: list[str], value: Column, block: str, name: str, backward: bool = False) -> DataFrame:
    """Adds the value of the row before (``backward``: after) in the group; null for the first."""
    key = F.struct(*order)
    edge = (F.min_by if backward else F.max_by)(F.struct(value.alias("v")), key)
    rows = _carried(df, group, block, edge, lambda along: F.lag("__sum").over(along), backward)
    inner = Window.partitionBy(*group, block).orderBy(*order)
    near = (F.lead if backward else F.lag)(F.struct(value.alias("v"))).over(inner)
    return rows.withColumn("__near", near).withColumn(name, F.coalesce("__near", "__carry")["v"]).drop("__near", "__carry")


def with_running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, block: str, name: str) -> DataFrame:
    """Adds the sum of the value from the group's first row to this one."""
    rows = _carried(df.withColumn("__v", value), group, block, F.sum("__v"), lambda along: F.sum("__sum").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce("__carry", F.lit(0)) + F.sum("__v").over(inner)).drop("__v", "__carry")


def with_last_known(df: DataFrame, group: list[str], order: list[str], value: Column, block: str, name: str) -> DataFrame:
    """Adds the last value that is not null up to this row; null if there is none yet."""
    rows = df.withColumn("__v", value)
    known = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order)))
    rows = _carried(rows, group, block, known, lambda along: F.last("__sum", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(inner), F.col("__carry"))).drop("__v", "__carry")


def with_numbers(df: DataFrame, order: str, width: int, ties: list[str], name: str) -> DataFrame:
    """Adds 1, 2, ... over all rows by a numeric column (nulls last), without gathering them: numbers within ranges of ``width``, plus the counts of the ranges before."""
    rows = df.withColumn("__range", F.floor(F.col(order) / width))
    before = F.sum("__n").over(Window.orderBy(F.col("__range").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_last(), *ties)
    return _same(rows, ranges, ["__range"]).withColumn(name, F.col("__before") + F.row_number().over(inner)).drop("__range", "__before")
