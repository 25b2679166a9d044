"""Ordered events: neighbours, runs, sessions, thresholds with memory.

Operators that take ``block`` cut long groups by it (a column that grows with the order), so that a group of any size is
spread over tasks; the order must be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflux.plans.blocks import with_last_known, with_previous, with_running_sum


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def consecutive_pairs(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the value of the row after it; the last of a group is left out."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("next_value", F.lead(value).over(w)).where(F.col("next_value").isNotNull())


def runs(df: DataFrame, group: list[str], order: list[str], value: str, block: str) -> DataFrame:
    """Neighbouring rows of equal value as one: run number, value, length, first and last place."""
    marked = with_previous(df, group, order, F.col(value), block, "__was")
    numbered = with_running_sum(marked, group, order, F.when(F.col("__was").eqNullSafe(F.col(value)), 0).otherwise(1), block, "run")
    placed = with_running_sum(numbered, group, order, F.lit(1), block, "__place")
    return placed.groupBy(*group, "run").agg(F.min(value).alias("value"), F.count(F.lit(1)).alias("steps"), F.min("__place").alias("first_place"), F.max("__place").alias("last_place"))


def transitions(df: DataFrame, group: str, order: list[str], value: str, block: str) -> DataFrame:
    """How often the value changes within each group."""
    rows = with_previous(df, [group], order, F.col(value), block, "__was")
    return rows.groupBy(group).agg(F.count_if(F.col(value) != F.col("__was")).alias("changes"))


def flicker(df: DataFrame, group: str, order: str, state: str, near: int = 2, far: int = 6) -> DataFrame:
    """Toggles that follow the one before within ``near`` steps, or the one before that within ``far``."""
    w = Window.partitionBy(group).orderBy(order)
    steps = df.withColumn("step", F.row_number().over(w)).withColumn("__was", F.lag(state).over(w))
    toggles = steps.where(F.col(state) != F.col("__was"))
    t = Window.partitionBy(group).orderBy("step")
    marked = toggles.withColumn("flickers", F.coalesce((F.col("step") - F.lag("step", 1).over(t) <= near) | (F.col("step") - F.lag("step", 2).over(t) <= far), F.lit(False)))
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("toggles"), F.count_if("flickers").alias("flickers"))


def since_last(df: DataFrame, group: str, ts: str, order: str, is_mark: Column, block: str) -> DataFrame:
    """Adds the time of the last marked event of the group, the row itself included; null before the first."""
    return with_last_known(df, [group], [ts, order], F.when(is_mark, F.col(ts)), block, "last_mark")


def gaps(df: DataFrame, group: str, ts: str, order: str, block: str) -> DataFrame:
    """Adds the microseconds since the row before in the group."""
    rows = with_previous(df, [group], [ts, order], F.col(ts), block, "__before")
    return rows.withColumn("gap_us", _micros(F.col(ts)) - _micros(F.col("__before"))).drop("__before")


def sessions(df: DataFrame, group: str, ts: str, gap: str) -> DataFrame:
    """Sessions by idle time: events up to exactly ``gap`` apart are one session."""
    return df.groupBy(group, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("s")


def hysteresis(df: DataFrame, group: str, order: list[str], value: str, low: float, high: float, block: str) -> DataFrame:
    """A switch that turns on at ``high`` and off at ``low``, and else keeps its state (off at first)."""
    decided = F.when(F.col(value) >= high, 1).when(F.col(value) <= low, 0)
    rows = with_last_known(df, [group], order, decided, block, "__known")
    return rows.withColumn("state", F.coalesce("__known", F.lit(0))).drop("__known")


def first_decisive(df: DataFrame, group: list[str], order: Column, kind: Column) -> DataFrame:
    """The kind of the first row of each group that decides; ``none`` if no row does."""
    return df.groupBy(*group).agg(F.coalesce(F.min_by(kind, F.when(kind.isNotNull(), order)), F.lit("none")).alias("kind"))


def debounce(df: DataFrame, group: str, ts: str, order: str, quiet_us: int, block: str) -> DataFrame:
    """Events after which the group is quiet for ``quiet_us`` microseconds or more, or ends."""
    rows = with_previous(df, [group], [ts, order], F.col(ts), block, "__after", backward=True)
    wait = _micros(F.col("__after")) - _micros(F.col(ts))
    return rows.where(wait.isNull() | (wait >= quiet_us)).drop("__after")


def frame_pairing(df: DataFrame, frame: Column, pointer: Column, value: str, order: str) -> DataFrame:
    """Last value of each of two pointers within a frame."""
    return df.groupBy(frame.alias("frame")).agg(F.max_by(value, F.when(pointer == 0, F.col(order))).alias("first_pointer"), F.max_by(value, F.when(pointer == 1, F.col(order))).alias("second_pointer"))


def history_back(df: DataFrame, group: str, order: list[str], state: str, block: str) -> DataFrame:
    """The state that going back from each row restores."""
    return with_previous(df, [group], order, F.col(state), block, "back")


def coalesce_gaps(df: DataFrame, group: str, start: Column, end: Column, reach: float) -> DataFrame:
    """Intervals lengthened by ``reach`` at both ends, those that touch joined into one; those without an end stand alone, after the others."""
    long = df.select(group, (start - reach).alias("s"), (end + reach).alias("e"))
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = long.withColumn("__new", F.when(before >= F.col("s"), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("parts"))
