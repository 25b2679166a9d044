"""Spans of regular expressions with DataFrame functions alone.

``split`` gives what stands between the leftmost non-overlapping matches and ``regexp_extract_all`` the matches; the two
alternate, so a match starts where the lengths of all that came before it end. Lengths count code points. All patterns here
are linear on any text: possessive where nothing is given back, and tied to the start of a run (or the end of the match
before), so that no run is walked again from each of its places and no group repeats by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflux.plans.lineage import materialize

#: Matches whose lengths are added up one by one; longer lists are summed in blocks, so cost stays near linear.
BLOCK = 256


def starts(sizes: Column) -> Column:
    """Exclusive prefix sums of an array of ints."""
    zero = F.lit(0).cast("int")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda x, y: x + y)

    n = F.size(sizes)
    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, BLOCK)))
    before = F.aggregate(blocks, F.array(zero), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))
    by_place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(before, (i / BLOCK).cast("int") + 1) + total(F.slice(sizes, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(zero)).otherwise(by_place)


def with_matches(df: DataFrame, text: str, name: str, pattern: str, context: bool = False) -> DataFrame:
    """Adds ``name``: array of (start, end, value[, left, right]) of the matches of ``pattern`` in a non-null ``text``; end exclusive.

    ``left`` and ``right`` are the text between a match and its neighbours.
    """
    found, gaps, sizes, at = (f"__{name}_{x}" for x in ("found", "gaps", "sizes", "at"))
    out = df.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    out = out.withColumn(gaps, F.when(F.size(found) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(sizes, F.transform(F.col(found), lambda m, i: F.length(F.get(F.col(gaps), i)) + F.length(m)))
    out = out.withColumn(at, starts(F.col(sizes)))

    def span(m: Column, i: Column) -> Column:
        start = F.get(F.col(at), i) + F.length(F.get(F.col(gaps), i))
        fields = [start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value")]
        if context:
            fields += [F.get(F.col(gaps), i).alias("left"), F.get(F.col(gaps), i + 1).alias("right")]
        return F.struct(*fields)

    return out.withColumn(name, F.transform(F.col(found), span)).drop(found, gaps, sizes, at)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes and the length: what rows of equal text share."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("roomflux"), text).alias("k2"), F.length(text).alias("k3")]


KEY = ["k1", "k2", "k3"]

#: A bitmap of keys: longs of 64 bits, one row each.
MARKS = 1 << 18


def likely(rows: DataFrame, key: str, keys: DataFrame, name: str = "likely") -> DataFrame:
    """``rows`` with ``name``: false only where ``key`` (a 64-bit hash) is surely not in ``keys`` (one column of such hashes).

    The keys are marked in a bitmap of ``MARKS`` longs at most, which is broadcast, whatever their number: what few keys
    concern is told apart without a shuffle of ``rows``, and an exact join is left to the rows that may be concerned.
    """
    mark = keys.toDF("__key").where("__key is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("__key", 20).bitwiseAND(F.lit(63)).cast("int"))
    marks = mark.groupBy(F.col("__key").bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("__at")).agg(F.bit_or(bit).alias("__bits"))
    marks = F.broadcast(materialize(marks, "marks"))  # at most MARKS rows
    own = F.shiftrightunsigned(F.col(key), 20).bitwiseAND(F.lit(63)).cast("int")
    out = rows.join(marks, F.col(key).bitwiseAND(F.lit(MARKS - 1)).cast("int") == F.col("__at"), "left")
    met = F.coalesce(F.call_function("shiftrightunsigned", F.col("__bits"), own).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return out.withColumn(name, met).drop("__at", "__bits")
