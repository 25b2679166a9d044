"""Timetables: compaction to week bitmasks, free/busy answers at an instant, gaps and order of rooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END_OF_DAY = 1440


def weekly_slots(bookings: DataFrame, weeks: int, by=("room", "day", "t_from", "t_to", "kind")) -> DataFrame:
    """One row per slot with the set of its weeks as a bitmask (bit week - 1); weeks outside 1..``weeks`` are left out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("week") - 1)
    return bookings.where(F.col("week").between(1, weeks)).groupBy(*by).agg(F.bit_or(bit).alias("mask"))


def late_weeks(bookings: DataFrame, weeks: int, by: str = "room") -> DataFrame:
    """Bookings by group, and how many lie outside the term."""
    return bookings.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("week").between(1, weeks)).alias("late"))


def occupancy(rooms: DataFrame, slots: DataFrame, day: int, week: int, minute: int, weeks: int, holiday: bool = False) -> DataFrame:
    """State of each room (room, shared) at an instant: state, until, next_from.

    ``none`` outside the term or on a no-class day, else ``busy`` during a slot (half-open), else ``maybe`` if shared, else
    ``free``. ``until``: end of the slot that is on. ``next_from``: next start of that day, 1440 for none.
    """
    mask = F.col("mask").bitwiseAND(F.lit(1 << max(0, week - 1))) != 0
    today = slots.where((F.col("day") == day) & mask)
    on = (F.col("t_from") <= minute) & (F.lit(minute) < F.col("t_to"))
    now = today.groupBy("room").agg(F.max(F.when(on, F.col("t_to"))).alias("until"), F.min(F.when(F.col("t_from") > minute, F.col("t_from"))).alias("next_from"))
    outside = holiday or not 1 <= week <= weeks
    state = F.lit("none") if outside else F.when(F.col("until").isNotNull(), "busy").when(F.col("shared"), "maybe").otherwise("free")
    until = F.lit(None).cast("int") if outside else F.col("until")
    return rooms.join(now, "room", "left").select("room", state.alias("state"), until.alias("until"), F.coalesce("next_from", F.lit(END_OF_DAY)).alias("next_from"))


def next_booking(bookings: DataFrame, by=("room", "day", "week"), start: str = "t_from", end: int = END_OF_DAY) -> DataFrame:
    """The start of the next distinct slot in the same group, ``end`` for none."""
    distinct = bookings.select(*by, start).distinct()
    return distinct.withColumn("next_from", F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), F.lit(end)))


def first_gap(rooms: DataFrame, slots: DataFrame, first: int = 480, last: int = 1199, step: int = 15) -> DataFrame:
    """First minute, on a scan by ``step``, at which a room has no slot; null if there is none."""
    scan = rooms.select("room", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("minute"))
    busy = slots.select("room", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("minute"), "t_from", "t_to").where((F.col("t_from") <= F.col("minute")) & (F.col("minute") < F.col("t_to"))).select("room", "minute").distinct()
    free = scan.join(busy, ["room", "minute"], "left_anti").groupBy("room").agg(F.min("minute").alias("gap"))
    return rooms.select("room").join(free, "room", "left")


def availability_order(walk: Column | None = None) -> list[Column]:
    """Sort keys: free, maybe, busy, none; busy by end; free by walking time if given, else by latest next start; then room."""
    group = F.when(F.col("state") == "free", 0).when(F.col("state") == "maybe", 1).when(F.col("state") == "busy", 2).otherwise(3)
    free = walk if walk is not None else -F.col("next_from")
    return [group, F.when(F.col("state") == "busy", F.col("until")).when(F.col("state") == "free", free).otherwise(0), F.col("room")]


def availability_rank(states: DataFrame, walk: Column | None = None) -> DataFrame:
    """Adds the place of each room in the list. Rooms are a dimension: one window over all of them."""
    return states.withColumn("place", F.row_number().over(Window.orderBy(*availability_order(walk))))


def nested_slots(slots: DataFrame, by: str = "room") -> DataFrame:
    """A sorted array of slots per room."""
    return slots.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("day", "t_from", "t_to", "mask", "kind"))).alias("slots"))
