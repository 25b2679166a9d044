"""Queries over bookings."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomflux.operators import schedule as S
from roomflux.registry import register
from roomflux.tables import BOOKINGS_SQL, ROOMS, WEEKS, bookings, table, week_number

DAY, WEEK, MINUTE = 3, 2, 570
SLOTS_SQL = f"""slots AS (SELECT room, day, t_from, t_to, kind, bit_or(CAST(1 AS BIGINT) << (week - 1)) AS mask
  FROM bookings WHERE week BETWEEN 1 AND {WEEKS} GROUP BY ALL)"""
STATE_SQL = f"""now AS (SELECT room, max(CASE WHEN t_from <= {MINUTE} AND {MINUTE} < t_to THEN t_to END) AS until, min(CASE WHEN t_from > {MINUTE} THEN t_from END) AS next_from
  FROM slots WHERE day = {DAY} AND (mask & {1 << (WEEK - 1)}) <> 0 GROUP BY room),
states AS (SELECT r.room, CASE WHEN until IS NOT NULL THEN 'busy' WHEN r.shared THEN 'maybe' ELSE 'free' END AS state, until, coalesce(next_from, 1440) AS next_from
  FROM (SELECT CAST(range AS INT) AS room, range % 5 = 0 AS shared FROM range({ROOMS})) r LEFT JOIN now USING (room))"""


def rooms(spark):
    return spark.range(ROOMS).select(F.col("id").cast("int").alias("room"), (F.col("id") % 5 == 0).alias("shared"))


def slots(spark, sf_dir):
    return S.weekly_slots(bookings(spark, sf_dir), WEEKS)


def states(spark, sf_dir):
    return S.occupancy(rooms(spark), slots(spark, sf_dir), DAY, WEEK, MINUTE, WEEKS)


@register(f"WITH {BOOKINGS_SQL}, {SLOTS_SQL} SELECT * FROM slots")
def weekly_slots(spark, sf_dir):
    return slots(spark, sf_dir)


@register(f"WITH {BOOKINGS_SQL} SELECT room, count(*) AS rows, count(*) FILTER (week NOT BETWEEN 1 AND {WEEKS}) AS late FROM bookings GROUP BY room")
def late_weeks(spark, sf_dir):
    return S.late_weeks(bookings(spark, sf_dir), WEEKS)


@register("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(floor(datediff('day', DATE '1997-01-06', CAST(o_orderdate AS DATE)) / 7.0) + 1 AS INT) AS week,
  CAST(isodow(o_orderdate) AS INT) AS day, DATE '1997-01-06' + CAST(floor(datediff('day', DATE '1997-01-06', CAST(o_orderdate AS DATE)) / 7.0) * 7 AS INT) AS monday FROM orders""")
def week_number_of_date(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    week = week_number(F.col("d"), "1997-01-06")
    return d.select("d", week.alias("week"), (F.weekday("d") + 1).alias("day"), F.date_add(F.lit("1997-01-06").cast("date"), (week - 1) * 7).alias("monday"))


@register(f"WITH {BOOKINGS_SQL}, {SLOTS_SQL}, {STATE_SQL} SELECT * FROM states")
def occupancy_status(spark, sf_dir):
    return states(spark, sf_dir)


@register(f"""WITH {BOOKINGS_SQL}, {SLOTS_SQL} SELECT CAST(range AS INT) AS room, 'none' AS state, CAST(NULL AS INT) AS until,
  coalesce((SELECT min(t_from) FROM slots s WHERE s.room = range AND day = {DAY} AND (mask & {1 << (WEEK - 1)}) <> 0 AND t_from > {MINUTE}), 1440) AS next_from FROM range({ROOMS})""")
def occupancy_no_class_day(spark, sf_dir):
    return S.occupancy(rooms(spark), slots(spark, sf_dir), DAY, WEEK, MINUTE, WEEKS, holiday=True)


@register(f"""WITH {BOOKINGS_SQL}, d AS (SELECT DISTINCT room, day, week, t_from FROM bookings)
SELECT room, day, week, t_from, coalesce(lead(t_from) OVER (PARTITION BY room, day, week ORDER BY t_from), 1440) AS next_from FROM d""")
def next_booking(spark, sf_dir):
    return S.next_booking(bookings(spark, sf_dir))


@register(f"""WITH {BOOKINGS_SQL}, s AS (SELECT DISTINCT room, t_from, t_to FROM bookings WHERE day = {DAY} AND week = {WEEK}),
scan AS (SELECT CAST(r.range AS INT) AS room, CAST(m.range AS INT) AS minute FROM range({ROOMS}) r, range(480, 1200, 15) m),
free AS (SELECT * FROM scan WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.room = scan.room AND t_from <= minute AND minute < t_to))
SELECT CAST(r.range AS INT) AS room, min(minute) AS gap FROM range({ROOMS}) r LEFT JOIN free ON free.room = r.range GROUP BY 1""")
def first_gap(spark, sf_dir):
    today = bookings(spark, sf_dir).where((F.col("day") == DAY) & (F.col("week") == WEEK)).select("room", "t_from", "t_to").distinct()
    return S.first_gap(rooms(spark), today)


RANK = """CASE state WHEN 'free' THEN 0 WHEN 'maybe' THEN 1 WHEN 'busy' THEN 2 ELSE 3 END, CASE state WHEN 'busy' THEN until WHEN 'free' THEN {free} ELSE 0 END, room"""


@register(f"WITH {BOOKINGS_SQL}, {SLOTS_SQL}, {STATE_SQL} SELECT *, row_number() OVER (ORDER BY {RANK.format(free='-next_from')}) AS place FROM states")
def availability_rank(spark, sf_dir):
    return S.availability_rank(states(spark, sf_dir))


@register(f"WITH {BOOKINGS_SQL}, {SLOTS_SQL}, {STATE_SQL} SELECT *, row_number() OVER (ORDER BY {RANK.format(free='room * 7 % 13')}) AS place FROM states")
def availability_rank_from_origin(spark, sf_dir):
    return S.availability_rank(states(spark, sf_dir), walk=F.col("room") * 7 % 13)


@register(f"""WITH {BOOKINGS_SQL}, {SLOTS_SQL} SELECT room, count(*) AS n, string_agg(concat_ws('/', day, t_from, t_to, mask, kind), ';' ORDER BY day, t_from, t_to, mask, kind) AS slots FROM slots GROUP BY room""")
def nested_slots(spark, sf_dir):
    nested = S.nested_slots(slots(spark, sf_dir))
    return nested.select("room", F.size("slots").cast("long").alias("n"), F.array_join(F.transform("slots", lambda s: F.concat_ws("/", s["day"], s["t_from"], s["t_to"], s["mask"], s["kind"])), ";").alias("slots"))


@register(f"""WITH {BOOKINGS_SQL}, {SLOTS_SQL} SELECT room, '{{"room":' || room || ',"slots":[' ||
  string_agg('{{"day":' || day || ',"t_from":' || t_from || ',"t_to":' || t_to || ',"mask":' || mask || ',"kind":"' || kind || '"}}', ',' ORDER BY day, t_from, t_to, mask, kind) || ']}}' AS document FROM slots GROUP BY room""")
def nested_document(spark, sf_dir):
    nested = S.nested_slots(slots(spark, sf_dir))
    return nested.select("room", F.to_json(F.struct("room", "slots")).alias("document"))


@register(f"WITH {BOOKINGS_SQL} SELECT week, day, kind, count(*) AS n FROM bookings GROUP BY ALL")
def kind_counts(spark, sf_dir):
    return bookings(spark, sf_dir).groupBy("week", "day", "kind").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {BOOKINGS_SQL}, {SLOTS_SQL}, w AS (SELECT slots.*, range AS bit FROM slots, range({WEEKS}) WHERE (mask >> range) & 1 = 1)
SELECT room, day, t_from, t_to, kind, CAST(bit + 1 AS INT) AS week FROM w""")
def slot_weeks(spark, sf_dir):
    """The bitmask read back: one row per slot and week."""
    weeks = F.filter(F.sequence(F.lit(1), F.lit(WEEKS)), lambda w: F.call_function("bit_get", F.col("mask"), w - 1) == 1)
    return slots(spark, sf_dir).select("room", "day", "t_from", "t_to", "kind", F.explode(weeks).alias("week"))
