"""Lookups, duplicate rules and overlays between inconsistent registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflux.plans.blocks import with_numbers


def project_by_header(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns as strings, by the first header of that name; ValueError names what is missing."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(c).cast("string").alias(c) for c in wanted))


def left_lookup(rows: DataFrame, register: DataFrame, key: str, separator: str = " - ") -> DataFrame:
    """Left join of ``rows.key`` with a register whose names may list several keys; of repeated keys the last row (by pos) wins."""
    keys = register.select(F.explode(F.split("name", separator)).alias("__k"), "*").withColumn("__k", F.upper(F.trim("__k")))
    last = keys.groupBy("__k").agg(F.max_by(F.struct("name", "value"), "pos").alias("r"))
    return rows.join(last, F.upper(F.col(key)) == F.col("__k"), "left").drop("__k")


def last_wins(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Of the rows of a key the one with the greatest order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose key has one value only: a key with several loses all its rows. Aggregated before the join, so hot keys stay small."""
    single = df.groupBy(key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where(F.col("__lo") == F.col("__hi")).select(key)
    return df.join(single, key, "left_semi")


def mode_per_group(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals that met first."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("r")).select(group, f"r.{value}", "r.n")


def dictionary_encode(df: DataFrame, value: str, order: str, width: int = 1_000_000) -> DataFrame:
    """value, code: dense ids from 0 in the order of first sight (a numeric column), numbered by ranges of ``width``."""
    first = df.groupBy(value).agg(F.min(order).alias("__first"))
    return with_numbers(first, "__first", width, [value], "__n").select(value, (F.col("__n") - 1).alias("code"))


def two_way_except(observed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, side: ``new`` if only observed, ``stale`` if only known."""
    new = observed.select(key).distinct().join(known.select(key), key, "left_anti").withColumn("side", F.lit("new"))
    stale = known.select(key).distinct().join(observed.select(key), key, "left_anti").withColumn("side", F.lit("stale"))
    return new.unionByName(stale)


def override_layer(base: DataFrame, local: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs of ``base`` with those of ``local`` over them; a value stays with one key, that of the top layer, then the least key."""
    both = base.select(key, F.col(value).alias("__b")).join(local.select(key, F.col(value).alias("__l")), key, "full")
    merged = both.select(key, F.coalesce("__l", "__b").alias(value), F.col("__l").isNotNull().alias("local"))
    best = Window.partitionBy(value).orderBy(F.col("local").desc(), key)
    return merged.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def dictionary_by_use(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Each value with its number from 0 in the order of first use. The window runs over the dictionary, one row a value; a null value is one too."""
    first = df.groupBy(value).agg(F.min(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("__first"))
    return first.select(value, (F.row_number().over(Window.orderBy("__first")) - 1).cast("int").alias("code"))


def fresh_or_cached(fresh: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """The fresh value where there is one, else the cached one, and which it was."""
    both = fresh.select(key, F.col(value).alias("__f")).join(cached.select(key, F.col(value).alias("__c")), key, "full")
    return both.select(key, F.coalesce("__f", "__c").alias(value), F.when(F.col("__f").isNotNull(), "fresh").otherwise("cached").alias("origin"))


def inherit_parent(children: DataFrame, parents: DataFrame, parent: str, value: str) -> DataFrame:
    """A child's own value, else its parent's."""
    up = parents.select(F.col("id").alias(parent), F.col(value).alias("__up"))
    return children.join(up, parent, "left").withColumn(value, F.coalesce(value, "__up")).drop("__up")


def line_pack(df: DataFrame, group: Column, item: Column, width: int, separator: str = ", ") -> DataFrame:
    """Items of each group in order, packed greedily into lines of at most ``width`` characters (a longer item has its own)."""
    lines = df.groupBy(group.alias("grp")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<string>")
    packed = F.aggregate(
        "items",
        F.struct(empty.alias("lines"), F.lit("").alias("line")),
        lambda a, x: F.when(a["line"] == "", F.struct(a["lines"].alias("lines"), x.alias("line")))
        .when(F.length(a["line"]) + len(separator) + F.length(x) <= width, F.struct(a["lines"].alias("lines"), F.concat(a["line"], F.lit(separator), x).alias("line")))
        .otherwise(F.struct(F.concat(a["lines"], F.array(a["line"])).alias("lines"), x.alias("line"))),
        lambda a: F.concat(a["lines"], F.array(a["line"])),
    )
    return lines.select("grp", F.posexplode(packed).alias("line_no", "line"))


def first_ok_else_best(df: DataFrame, group: str, ok: Column, priority: Column, error: Column, value: str) -> DataFrame:
    """The first candidate that is within tolerance, by priority; if there is none, that of least error."""
    first = F.min_by(value, F.when(ok, priority))
    return df.groupBy(group).agg(F.coalesce(first, F.min_by(value, F.struct(error, priority))).alias("choice"), F.max(ok.cast("int")).alias("within"))


def ordinal_diff(expected: DataFrame, actual: DataFrame, ordinal: str, value: str) -> DataFrame:
    """Positions at which two lists differ, or where one has ended."""
    both = expected.select(ordinal, F.col(value).alias("expected")).join(actual.select(ordinal, F.col(value).alias("actual")), ordinal, "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))
