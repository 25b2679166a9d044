"""Readers of the driver tables and adapters that give them the shapes of schedules, grids and registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Monday: the first day of the schedule's first week.
FIRST_MONDAY = "2024-01-01"
WEEKS = 4
ROOMS = 24
GRID = 15
WALKABLE = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_number(day: Column, first: str = FIRST_MONDAY) -> Column:
    """1 for the week that starts on ``first``; 0 and less before it."""
    return (F.floor(F.datediff(day, F.lit(first)) / 7) + 1).cast("int")


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bookings: event_id, ts, room, day (1 Monday to 7), t_from, t_to (minutes), week, kind, value."""
    e = table(spark, sf_dir, "events")
    start = (F.floor(F.hour("ts") / 2) * 120).cast("int")
    return e.select("event_id", "ts", (F.col("user_id") % ROOMS).cast("int").alias("room"), (F.weekday("ts") + 1).alias("day"), start.alias("t_from"), (start + 100).alias("t_to"), week_number(F.to_date("ts")).alias("week"), F.col("event_type").alias("kind"), "value")


BOOKINGS_SQL = f"""bookings AS (
  SELECT event_id, ts, CAST(user_id % {ROOMS} AS INT) AS room, CAST(isodow(ts) AS INT) AS day,
    CAST((hour(ts) // 2) * 120 AS INT) AS t_from, CAST((hour(ts) // 2) * 120 + 100 AS INT) AS t_to,
    CAST(floor(datediff('day', DATE '{FIRST_MONDAY}', CAST(ts AS DATE)) / 7.0) + 1 AS INT) AS week, event_type AS kind, value
  FROM events)"""

LEVELS = ("click", "error", "purchase", "signup", "view")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walkable cells of a building with a level per event type: node, level, i, j."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("event_type")).cast("int")
    cells = table(spark, sf_dir, "events").groupBy(level.alias("level"), (F.col("user_id") % GRID).cast("int").alias("i"), F.floor(F.col("user_id") / GRID).cast("int").alias("j")).count().where(F.col("count") >= WALKABLE)
    return cells.select((F.col("level") * 1_000_000 + F.col("i") * 10_000 + F.col("j")).cast("long").alias("node"), "level", "i", "j")


def grid_edges(cells: DataFrame, portal: int = 5, climb: int = 3) -> DataFrame:
    """a, b, w in both directions: 4-neighbours within a level, and portals between consecutive levels."""
    steps = F.array(*(F.struct(F.lit(dl).alias("dl"), F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(w).alias("w")) for dl, di, dj, w in ((0, 1, 0, 1), (0, -1, 0, 1), (0, 0, 1, 1), (0, 0, -1, 1), (1, 0, 0, climb), (-1, 0, 0, climb))))
    out = cells.select(F.col("node").alias("a"), "level", "i", "j", F.inline(steps)).where((F.col("dl") == 0) | ((F.col("i") % portal == 0) & (F.col("j") % portal == 0)))
    other = cells.select(F.col("node").alias("b"), F.col("level").alias("bl"), F.col("i").alias("bi"), F.col("j").alias("bj"))
    return out.join(other, (F.col("bl") == F.col("level") + F.col("dl")) & (F.col("bi") == F.col("i") + F.col("di")) & (F.col("bj") == F.col("j") + F.col("dj"))).select("a", "b", "w")


CELLS_SQL = f"""cells AS (
  SELECT CAST(level * 1000000 + i * 10000 + j AS BIGINT) AS node, level, i, j FROM (
    SELECT CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INT) AS level, CAST(user_id % {GRID} AS INT) AS i, CAST(user_id // {GRID} AS INT) AS j, count(*) AS n
    FROM events GROUP BY ALL) WHERE n >= {WALKABLE})"""


def edges_sql(portal: int = 5, climb: int = 3, name: str = "edges") -> str:
    return f"""{name} AS (
  SELECT a.node AS a, b.node AS b, CASE WHEN a.level = b.level THEN 1 ELSE {climb} END AS w FROM cells a JOIN cells b ON
    (a.level = b.level AND abs(a.i - b.i) + abs(a.j - b.j) = 1)
    OR (abs(a.level - b.level) = 1 AND a.i = b.i AND a.j = b.j AND a.i % {portal} = 0 AND a.j % {portal} = 0))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as plane points in metres: id, x, y (two decimals), label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.get("embedding", F.lit(0)).cast("double") * 100, 2).alias("x"), F.round(F.get("embedding", F.lit(1)).cast("double") * 100, 2).alias("y"), "label")


POINTS_SQL = "points AS (SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 100, 2) AS x, round(CAST(embedding[2] AS DOUBLE) * 100, 2) AS y, label FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as label boxes: id, level, x0, y0, x1, y1 (integers), area."""
    x, y = (F.col("p_partkey") * 37 % 1000).cast("int"), (F.col("p_partkey") * 91 % 700).cast("int")
    w, h = F.col("p_size") + 4, F.col("p_size") % 7 + 3
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).cast("int").alias("level"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), (w * h).alias("area"))


BOXES_SQL = """boxes AS (SELECT p_partkey AS id, CAST(p_partkey % 5 AS INT) AS level, CAST(p_partkey * 37 % 1000 AS INT) AS x0, CAST(p_partkey * 91 % 700 AS INT) AS y0,
  CAST(p_partkey * 37 % 1000 AS INT) + p_size + 4 AS x1, CAST(p_partkey * 91 % 700 AS INT) + p_size % 7 + 3 AS y1, (p_size + 4) * (p_size % 7 + 3) AS area FROM part)"""
