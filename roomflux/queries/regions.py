"""Queries over regions given by their corners, and registration without a first guess."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roomflux.operators import regions as R
from roomflux.registry import register
from roomflux.tables import BOXES_SQL, boxes, points

TURN = 0.3
_C, _S = f"{math.cos(TURN)!r}::DOUBLE", f"{math.sin(TURN)!r}::DOUBLE"


def bent_rooms(spark, sf_dir):
    """Boxes without their upper right quarter, turned."""
    b = boxes(spark, sf_dir)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    c, s = math.cos(TURN), math.sin(TURN)
    corners = [(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1)]
    return b.select("id", F.array(*(F.struct((x * c - y * s).alias("x"), (x * s + y * c).alias("y")) for x, y in corners)).alias("ring"))


@register(f"""WITH {BOXES_SQL}, c AS (SELECT id, unnest([{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y0}}, {{'x': x1, 'y': my}}, {{'x': mx, 'y': my}}, {{'x': mx, 'y': y1}}, {{'x': x0, 'y': y1}}]) AS p, unnest([1, 2, 3, 4, 5, 6]) AS k
  FROM (SELECT id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (x0 + x1) / 2::DOUBLE AS mx, (y0 + y1) / 2::DOUBLE AS my FROM boxes)),
t AS (SELECT id, k, p.x * {_C} - p.y * {_S} AS x, p.x * {_S} + p.y * {_C} AS y FROM c),
d AS (SELECT a.id, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS u, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS v FROM t a JOIN t b ON a.id = b.id AND a.k <> b.k),
e AS (SELECT d.id, u, v, max(x * u + y * v) - min(x * u + y * v) AS along, max(y * u - x * v) - min(y * u - x * v) AS across FROM d JOIN t USING (id) GROUP BY ALL),
f AS (SELECT id, round(along * across, 6) AS area, round(round(degrees(atan2(v, u)) + CASE WHEN round(along, 6) >= round(across, 6) THEN 0 ELSE 90 END, 1), 1) AS a, round(greatest(along, across), 2) AS longer, round(least(along, across), 2) AS shorter FROM e),
g AS (SELECT id, area, CASE WHEN a > 90 THEN a - 180 WHEN a <= -90 THEN a + 180 ELSE a END AS angle, longer, shorter FROM f)
SELECT id, round(b.angle, 1) AS angle, b.longer AS longer, b.shorter AS shorter FROM (SELECT id, arg_min({{'angle': angle, 'longer': longer, 'shorter': shorter}}, (area, angle, longer, shorter)) AS b FROM g GROUP BY id)""")
def least_rectangles(spark, sf_dir):
    return R.least_rectangles(bent_rooms(spark, sf_dir)).withColumn("angle", F.round("angle", 1))


@register()
def label_anchors(spark, sf_dir):
    rooms = bent_rooms(spark, sf_dir).withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] / 10).alias("x"), (p["y"] / 10).alias("y"))))
    return R.label_anchors(rooms).select("id", *(F.round(c, 2).alias(c) for c in ("x", "y", "room")))


@register()
def coarse_registration(spark, sf_dir):
    fixed = points(spark, sf_dir).select("x", "y")
    c, s = math.cos(math.radians(40.0)), math.sin(math.radians(40.0))
    # The mirrored set turned back: flip -1 and 40 degrees bring it home.
    moving = fixed.select((F.col("x") * c + F.col("y") * s + 3).alias("x"), (F.col("x") * s - F.col("y") * c - 2).alias("y"))
    return R.coarse_registration(moving, fixed, 5.0).select("flip", "angle")
