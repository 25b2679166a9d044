"""Queries over drawing elements and door lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roomflux.operators import shapes as S
from roomflux.registry import register
from roomflux.tables import BOXES_SQL, boxes, table


@register("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id, event_type")
def first_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return S.first_seen(e, ["user_id", "event_type"], ["ts", "event_id"])


DOORS_SQL = """w AS (SELECT level, x0 / 10 AS x0, y0 / 10 AS y0, x1 / 10 AS x1, y1 / 10 AS y1 FROM boxes WHERE id % 3 = 0),
d AS (SELECT id, level, x0 / 10 - CASE id % 2 WHEN 0 THEN r ELSE 0 END AS ax, y0 / 10 - CASE id % 2 WHEN 0 THEN 0 ELSE r END AS ay, x0 / 10 + CASE id % 2 WHEN 0 THEN r ELSE 0 END AS bx, y0 / 10 + CASE id % 2 WHEN 0 THEN r / 2 ELSE r END AS by_
  FROM (SELECT *, CAST(id % 7 AS DOUBLE) / 20 + 0.5::DOUBLE AS r FROM boxes) WHERE id % 3 <> 0),
p AS (SELECT d.id, bx - ax AS dx, by_ - ay AS dy, ax, ay, x0, y0, x1, y1 FROM d JOIN w USING (level)),
s AS (SELECT id, dx, dy,
  CASE WHEN dx = 0 THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 0.0 ELSE 2.0 END ELSE least((x0 - ax) / dx, (x1 - ax) / dx) END AS fx, CASE WHEN dx = 0 THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 1.0 ELSE -1.0 END ELSE greatest((x0 - ax) / dx, (x1 - ax) / dx) END AS tx,
  CASE WHEN dy = 0 THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 0.0 ELSE 2.0 END ELSE least((y0 - ay) / dy, (y1 - ay) / dy) END AS fy, CASE WHEN dy = 0 THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 1.0 ELSE -1.0 END ELSE greatest((y0 - ay) / dy, (y1 - ay) / dy) END AS ty FROM p),
c AS (SELECT id, round(sum(greatest(0.0, least(tx, ty, 1.0) - greatest(fx, fy, 0.0)) * sqrt(dx * dx + dy * dy)), 6) AS covered FROM s GROUP BY id)"""


def door_lines(spark, sf_dir):
    """Lines through the corners of two thirds of the boxes, and the other boxes as walls."""
    b = boxes(spark, sf_dir).select("id", "level", *((F.col(c) / 10).alias(c) for c in ("x0", "y0", "x1", "y1")))
    r, across = (F.col("id") % 7).cast("double") / 20 + 0.5, F.col("id") % 2 == 0
    zero = F.lit(0.0)
    ends = {"ax": F.col("x0") - F.when(across, r).otherwise(zero), "ay": F.col("y0") - F.when(across, zero).otherwise(r), "bx": F.col("x0") + F.when(across, r).otherwise(zero), "by": F.col("y0") + F.when(across, r / 2).otherwise(r)}
    return b.where("id % 3 <> 0").select("id", "level", *(v.alias(k) for k, v in ends.items())), b.where("id % 3 = 0")


@register(f"WITH {BOXES_SQL}, {DOORS_SQL} SELECT id, covered FROM c WHERE covered > 0.05")
def blocked_doors(spark, sf_dir):
    return S.blocked_doors(*door_lines(spark, sf_dir), 4.0)


@register(f"WITH {BOXES_SQL}, {DOORS_SQL} SELECT id, level FROM d WHERE id NOT IN (SELECT id FROM c WHERE covered > 0.05)")
def open_doors(spark, sf_dir):
    return S.open_doors(*door_lines(spark, sf_dir), 4.0).select("id", "level")


STYLES = [(0.25, 0.5), (0.5, 0.0), (0.0, 1.0)]
TURN = (0.004 * math.cos(0.3), 0.004 * math.sin(0.3), 5.0, -2.5)
_C, _S, _X, _Y = (f"{v!r}::DOUBLE" for v in TURN)


@register(f"""WITH {BOXES_SQL}, l AS (SELECT *, CASE WHEN id % 4 < 3 THEN CAST(id % 4 AS DOUBLE) / 4 END AS width, CAST(id % 3 AS DOUBLE) / 2 AS grey FROM boxes),
m AS (SELECT id, x0 * {_C} - y0 * {_S} + {_X} AS u0, x0 * {_S} + y0 * {_C} + {_Y} AS v0, x1 * {_C} - y1 * {_S} + {_X} AS u1, x1 * {_S} + y1 * {_C} + {_Y} AS v1 FROM l
  WHERE (round(coalesce(width, 0), 3), round(grey, 2)) IN ({", ".join(f"({w}::DOUBLE, {g}::DOUBLE)" for w, g in STYLES)})),
n AS (SELECT *, u1 - u0 AS dx, v1 - v0 AS dy, sqrt((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0)) AS n FROM m)
SELECT id, round(u0 - dx / n * 0.02::DOUBLE, 4) AS ax, round(v0 - dy / n * 0.02::DOUBLE, 4) AS ay, round(u1 + dx / n * 0.02::DOUBLE, 4) AS bx, round(v1 + dy / n * 0.02::DOUBLE, 4) AS by FROM n WHERE n >= 0.03""")
def styled_cuts(spark, sf_dir):
    lines = boxes(spark, sf_dir).withColumn("width", F.when(F.col("id") % 4 < 3, (F.col("id") % 4).cast("double") / 4)).withColumn("grey", (F.col("id") % 3).cast("double") / 2)
    return S.styled_cuts(lines, spark.createDataFrame(STYLES, "width double, grey double"), TURN)


ELEMENTS_SQL = "e AS (SELECT id, ['wall', 'curtain', 'text'][CAST(id % 3 + 1 AS INT)] AS layer, ['f', 's', 'fs', 's'][CAST(id % 4 + 1 AS INT)] AS kind, ['l', 're', 'qu', 'c', 'l'][CAST(id % 5 + 1 AS INT)] AS item, CASE WHEN id % 7 > 0 THEN CAST(id % 7 AS DOUBLE) / 6 END AS fill, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM boxes)"


@register(f"""WITH {BOXES_SQL}, {ELEMENTS_SQL}, g AS (SELECT *, CASE WHEN kind = 's' THEN 1.2::DOUBLE ELSE 0 END AS g FROM e
  WHERE (kind <> 's' AND (layer = 'curtain' OR (layer = 'wall' AND fill > 0.7::DOUBLE))) OR (kind = 's' AND layer = 'curtain' AND item <> 'c'))
SELECT id, x0 - g AS x0, y0 - g AS y0, x1 + g AS x1, y1 + g AS y1 FROM g""")
def obstacles(spark, sf_dir):
    def pick(names, c):
        return F.get(F.array(*map(F.lit, names)), (c % len(names)).cast("int"))

    i = F.col("id")
    sides = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    e = boxes(spark, sf_dir).select("id", pick(["wall", "curtain", "text"], i).alias("layer"), pick(["f", "s", "fs", "s"], i).alias("kind"), pick(["l", "re", "qu", "c", "l"], i).alias("item"), F.when(i % 7 > 0, (i % 7).cast("double") / 6).alias("fill"), *sides)
    return S.obstacles(e, ["wall"], "curtain")
