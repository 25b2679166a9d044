"""Orders, searches and nearest-by choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflux.operators.spatial import nearest_ahead


def natural_order(code: Column) -> list[Column]:
    """Sort keys of codes like ``F03`` or ``2.10``: the F block first, then floor, number (99 if it has none) and the code."""
    floor = F.when(code.startswith("F"), -1).otherwise(F.coalesce(F.regexp_extract(code, r"^([0-9]+)\.", 1).try_cast("int"), F.lit(99)))
    number = F.coalesce(F.regexp_extract(code, r"([0-9]+)$", 1).try_cast("int"), F.lit(99))
    return [floor, number, code]


def search_rank(df: DataFrame, code: Column, text: str) -> DataFrame:
    """Rows whose code matches a query, dots and a leading ``BA.`` aside: exact first, then by prefix, then within."""
    def key(x: Column) -> Column:
        return F.replace(F.regexp_replace(F.upper(x), r"^BA\.", ""), F.lit("."), F.lit(""))

    own, want = key(code), key(F.lit(text))
    rank = F.when(own == want, 0).when(own.startswith(want), 1).when(own.contains(want), 2)
    return df.withColumn("rank", rank).where(F.col("rank").isNotNull())


def nearest_per_kind(df: DataFrame, kind: str, distance: Column, value: str) -> DataFrame:
    """Of each kind the nearest value; the least value among equals."""
    return df.groupBy(kind).agg(F.min_by(value, F.struct(distance, F.col(value))).alias(value), F.min(distance).alias("distance"))


def directional_neighbour(df: DataFrame, radius: float) -> DataFrame:
    """For each point (id, x, y) the nearest other point to its right, within 45 degrees, however far; by distance, then id.

    ``radius``: how far most points have to look; the answer does not depend on it.
    """
    return nearest_ahead(df, radius).select("id", F.col("near").alias("neighbour"))
