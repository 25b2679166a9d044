"""Queries over points, boxes, regions and grids."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from roomflux.operators import fit as T
from roomflux.operators import rank as R
from roomflux.operators import spatial as P
from roomflux.registry import register
from roomflux.tables import BOXES_SQL, CELLS_SQL, GRID, POINTS_SQL, boxes, grid_cells, points, table

HALVES = "a AS (SELECT * FROM points WHERE id % 2 = 0), b AS (SELECT * FROM points WHERE id % 2 = 1)"
PAIRS = "pr AS (SELECT a.id, b.id AS id_r, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM a JOIN b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r2})"


def halves(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "x", "y")
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


@register(f"WITH {POINTS_SQL}, {HALVES}, {PAIRS.format(r2=4.0)}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, id_r) AS n FROM pr) SELECT id, id_r AS near, round(d2, 6) AS d2 FROM k WHERE n = 1")
def nearest_within(spark, sf_dir):
    return P.nearest_within(*halves(spark, sf_dir), 2.0).withColumn("d2", F.round("d2", 6))


@register(f"WITH {POINTS_SQL}, {HALVES}, {PAIRS.format(r2=1.0)} SELECT id, x, y FROM a WHERE id NOT IN (SELECT id FROM pr)")
def range_anti(spark, sf_dir):
    return P.range_anti(*halves(spark, sf_dir), 1.0)


RINGS = [(k, [(-20.0 + 8 * (k % 5), -20.0 + 8 * (k // 5)), (-11.0 + 8 * (k % 5), -18.5 + 8 * (k // 5)), (-13.0 + 8 * (k % 5), -10.0 + 8 * (k // 5)), (-17.0 + 8 * (k % 5), -14.0 + 8 * (k // 5)), (-19.5 + 8 * (k % 5), -11.0 + 8 * (k // 5))]) for k in range(25)]
EDGES_SQL = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) + ") t(rid, ax, ay, bx, by_))"
CROSS = "(ay > {y}) <> (by_ > {y}) AND {x} < (bx - ax) * ({y} - ay) / (CASE WHEN by_ = ay THEN 1 ELSE by_ - ay END) + ax"


def regions(spark):
    return spark.createDataFrame(RINGS, "rid int, ring array<struct<x:double,y:double>>")


@register(f"WITH {POINTS_SQL}, {EDGES_SQL}, h AS (SELECT id, rid, count(*) FILTER ({CROSS.format(x='x', y='y')}) AS n FROM points, e GROUP BY id, rid) SELECT id, min(rid) AS rid FROM h WHERE n % 2 = 1 GROUP BY id")
def point_in_region(spark, sf_dir):
    return P.point_in_region(points(spark, sf_dir).select("id", "x", "y"), regions(spark), 4.0)


@register(f"WITH {EDGES_SQL}, g AS (SELECT r.rid, i.range AS i, j.range AS j, (i.range + 0.5::DOUBLE) * 0.45::DOUBLE AS cx, (j.range + 0.5::DOUBLE) * 0.45::DOUBLE AS cy FROM (SELECT DISTINCT rid FROM e) r, range(-60, 70) i, range(-60, 70) j), h AS (SELECT g.rid, i, j, count(*) FILTER ({CROSS.format(x='cx', y='cy')}) AS n FROM g JOIN e ON e.rid = g.rid GROUP BY ALL) SELECT rid, i, j FROM h WHERE n % 2 = 1")
def rasterize(spark, sf_dir):
    return P.rasterize(regions(spark), 0.45)


OVER = "a.level = b.level AND a.id < b.id AND a.x0 + {t} < b.x1 AND b.x0 + {t} < a.x1 AND a.y0 + {t} < b.y1 AND b.y0 + {t} < a.y1"


@register(f"WITH {BOXES_SQL} SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON {OVER.format(t=0.5)}")
def overlap_pairs(spark, sf_dir):
    return P.overlap_pairs(boxes(spark, sf_dir), 64)


#: Rows ``o`` (g, r, id) taken in turn within g; a row is kept unless one of its rivals in ``v`` (id, rivals) has been.
TURNS = """n AS (SELECT g, max(r) AS n FROM o GROUP BY g),
k AS (SELECT g, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept FROM n
  UNION ALL SELECT k.g, o.r, CASE WHEN list_has_any(k.kept, v.rivals) THEN k.kept ELSE list_append(k.kept, o.id) END FROM k JOIN o ON o.g = k.g AND o.r = k.r + 1 LEFT JOIN v ON v.id = o.id),
kept AS (SELECT k.g, k.kept FROM k JOIN n ON n.g = k.g AND n.n = k.r)"""


@register(f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT level AS g, id, row_number() OVER (PARTITION BY level ORDER BY area DESC, id) AS r FROM boxes),
v AS (SELECT b.id, list(a.id) AS rivals FROM boxes a JOIN boxes b ON a.level = b.level AND (a.area > b.area OR (a.area = b.area AND a.id < b.id)) AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY b.id),
{TURNS} SELECT id, level, area FROM boxes WHERE id IN (SELECT unnest(kept) FROM kept)""")
def greedy_nms(spark, sf_dir):
    return P.greedy_nms(boxes(spark, sf_dir), 64).select("id", "level", "area")


QUERIES = """q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT qid, vec_id AS id, list_sum(list_transform(list_zip(qe, embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS d2 FROM q, embeddings WHERE vec_id <> qid),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM d)"""


@register(f"WITH {QUERIES} SELECT qid, CAST(rank AS INT) AS rank, id, round(d2, 6) AS d2 FROM k WHERE rank <= 3")
def knn_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return P.nearest_vectors(rows, rows.where("id % 100 = 0"), 3).select("qid", "rank", "id", F.round("d2", 6).alias("d2"))


@register(f"WITH {CELLS_SQL} SELECT level, CAST(i * 200 + j AS INT) AS place FROM cells")
def bitmap_roundtrip(spark, sf_dir):
    """Cells lie in the bitmap by columns of ``GRID``, so that none share a bit however long the building is."""
    back = P.unpack_bits(P.pack_bits(grid_cells(spark, sf_dir), "level", F.col("j") * GRID + F.col("i")), "level")
    return back.select("level", (F.col("place") % GRID * 200 + F.floor(F.col("place") / GRID)).cast("int").alias("place"))


@register(f"WITH {CELLS_SQL}, a AS (SELECT i, j FROM cells WHERE level = 1), b AS (SELECT i, j FROM cells WHERE level = 2) SELECT 'union' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def cell_set_ops(spark, sf_dir):
    c = grid_cells(spark, sf_dir)
    a, b = (c.where(F.col("level") == k).select("i", "j") for k in (1, 2))
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    out = [df.select(F.lit(op).alias("op"), "i", "j") for op, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


ANGLE, SCALE, TX, TY = 0.3, 1.1, 5.0, -2.5


@register(f"WITH {POINTS_SQL} SELECT id, round(x * {SCALE * math.cos(ANGLE)!r} - y * {SCALE * math.sin(ANGLE)!r} + {TX}, 2) AS u, round(x * {SCALE * math.sin(ANGLE)!r} + y * {SCALE * math.cos(ANGLE)!r} + {TY}, 2) AS v FROM points")
def affine_points(spark, sf_dir):
    u, v = P.affine(F.col("x"), F.col("y"), SCALE, ANGLE, TX, TY)
    return points(spark, sf_dir).select("id", u.alias("u"), v.alias("v"))


def moved(spark, sf_dir):
    u, v = P.affine(F.col("x"), F.col("y"), SCALE, ANGLE, TX, TY)
    return points(spark, sf_dir).select("label", "x", "y", (u + F.col("id") % 7 * 0.01).alias("u"), (v - F.col("id") % 5 * 0.01).alias("v"))


FIT_SQL = """WITH {points}, m AS (SELECT label, x, y, round(x * {c!r} - y * {s!r} + {tx}, 2) + id % 7 * 0.01 AS u, round(x * {s!r} + y * {c!r} + {ty}, 2) - id % 5 * 0.01 AS v FROM points),
g AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM m GROUP BY 1),
z AS (SELECT m.label, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS dt, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS cr, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS sq FROM m JOIN g USING (label) GROUP BY 1),
f AS (SELECT *, atan2(cr, dt) AS angle, {scale} AS scale FROM z)
SELECT label, n, round(angle, 5) AS angle, round(scale, 5) AS scale, round(mu - scale * (cos(angle) * mx - sin(angle) * my), 4) AS tx, round(mv - scale * (sin(angle) * mx + cos(angle) * my), 4) AS ty FROM f"""
FIT = {"points": POINTS_SQL, "c": SCALE * math.cos(ANGLE), "s": SCALE * math.sin(ANGLE), "tx": TX, "ty": TY}


def rounded_fit(df):
    return df.select("label", "n", F.round("angle", 5).alias("angle"), F.round("scale", 5).alias("scale"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


@register(FIT_SQL.format(scale="sqrt(dt * dt + cr * cr) / sq", **FIT))
def similarity_fit(spark, sf_dir):
    return rounded_fit(T.similarity(moved(spark, sf_dir), ["label"]))


@register(FIT_SQL.format(scale="CAST(1.0 AS DOUBLE)", **FIT))
def rigid_fit(spark, sf_dir):
    return rounded_fit(T.similarity(moved(spark, sf_dir), ["label"], scaled=False))


@register()
def icp(spark, sf_dir):
    fixed = points(spark, sf_dir).select("id", "x", "y")
    c, s = math.cos(0.02), math.sin(0.02)
    moving = fixed.select("id", (F.col("x") * c + F.col("y") * s - 0.3).alias("x"), (F.col("y") * c - F.col("x") * s + 0.2).alias("y"))
    rows = [(k, r["gate"], r["pairs"], float(r["share"]), float(r["angle"]), float(r["tx"]), float(r["ty"])) for k, r in enumerate(T.icp(moving, fixed))]
    return spark.createDataFrame(rows, "round int, gate double, pairs long, share double, angle double, tx double, ty double")


SPANS = "s AS (SELECT id, round(x * 10) AS sx, round(y * 10) AS sy, label FROM points)"


@register(f"""WITH {POINTS_SQL}, {SPANS}, p AS (SELECT c.id, o.id AS oid, o.label, o.sy - c.sy AS dy FROM s c JOIN s o ON c.label = 0 AND o.label <> 0 AND abs(o.sx - c.sx) < 40 AND o.sy - c.sy > -2 AND o.sy - c.sy < 45)
SELECT id, arg_min(oid, dy * 1000000 + oid) FILTER (label = 1) AS name_id, arg_min(oid, dy * 1000000 + oid) FILTER (label = 2) AS area_id FROM p GROUP BY id""")
def proximity_attrs(spark, sf_dir):
    """For each code the first name and the first area below it, within a box of 80 by 47."""
    s = points(spark, sf_dir).select("id", F.round(F.col("x") * 10).alias("sx"), F.round(F.col("y") * 10).alias("sy"), "label")
    codes = s.where("label = 0").select("id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    others = s.where("label <> 0").select("id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("label").alias("kind"))
    return P.first_below(codes, others, 39, -1, 44).select("id", F.col("first").getItem(1).alias("name_id"), F.col("first").getItem(2).alias("area_id"))


@register(f"""WITH RECURSIVE {POINTS_SQL}, o AS (SELECT label AS g, id, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM points),
v AS (SELECT b.id, list(a.id) AS rivals FROM points a JOIN points b ON a.label = b.label AND a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64 GROUP BY b.id),
{TURNS}, t AS (SELECT g, kept, unnest(range(len(kept))) AS nth FROM kept) SELECT g AS label, CAST(nth AS INT) AS nth, kept[nth + 1] AS id FROM t""")
def spacing_dedup(spark, sf_dir):
    return P.spacing_dedup(points(spark, sf_dir).select("label", "id", "x", "y"), "label", F.col("id"), 8.0)


@register(f"WITH {POINTS_SQL} SELECT label, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(sum(x), 4) AS sx, count(*) FILTER (x > 0) AS right_side FROM points GROUP BY label")
def bbox_stats(spark, sf_dir):
    return points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.round(F.sum("x"), 4).alias("sx"), F.count_if(F.col("x") > 0).alias("right_side"))


@register(f"WITH {POINTS_SQL} SELECT label, round(ceil(greatest(0, 0.3 - min(x)) / 0.45) * 0.45, 6) AS shift_x, round(ceil(greatest(0, 0.3 - min(y)) / 0.45) * 0.45, 6) AS shift_y FROM points GROUP BY label")
def grid_align(spark, sf_dir):
    return points(spark, sf_dir).groupBy("label").agg(*(F.round(P.grid_align(F.min(c), 0.45), 6).alias(f"shift_{c}") for c in ("x", "y")))


@register(f"""WITH {BOXES_SQL}, e AS (SELECT id, x0, y0, x1, y1, CAST(greatest(1, floor(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 2.5)) AS INT) AS n FROM boxes)
SELECT id, CAST(k AS INT) AS k, round(x0 + (x1 - x0) * k / n::DOUBLE, 4) AS x, round(y0 + (y1 - y0) * k / n::DOUBLE, 4) AS y FROM (SELECT *, unnest(range(n)) AS k FROM e)""")
def edge_sampling(spark, sf_dir):
    return P.edge_samples(boxes(spark, sf_dir), 2.5)


FOLD = "CASE WHEN a % 180 > 90 THEN a % 180 - 180 ELSE a % 180 END"


@register(f"WITH a AS (SELECT p_partkey, CAST((p_partkey * 37) % 1080 AS DOUBLE) AS a FROM part) SELECT p_partkey, {FOLD} AS angle FROM a")
def fold_angle(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.fold_angle((F.col("p_partkey") * 37 % 1080).cast("double") - 1080.0).alias("angle"))


def walls(spark, sf_dir):
    k = F.col("id") % 4
    return points(spark, sf_dir).select("id", "x", "y", F.when(k == 0, 1.0).when(k == 2, -1.0).otherwise(0.0).alias("nx"), F.when(k == 1, 1.0).when(k == 3, -1.0).otherwise(0.0).alias("ny"), (0.5 + F.col("label") * 0.25).alias("half"))


@register(f"""WITH {POINTS_SQL}, w AS (SELECT id, x, y, CASE id % 4 WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END AS nx, CASE id % 4 WHEN 1 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS ny, 0.5 + label * 0.25 AS half FROM points),
p AS (SELECT a.id, b.id AS o, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM w a JOIN w b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9
  AND a.nx * b.nx + a.ny * b.ny <= -0.94 AND (b.x - a.x) * a.nx + (b.y - a.y) * a.ny >= 0 AND a.half + b.half - abs((b.x - a.x) * -a.ny + (b.y - a.y) * a.nx) >= 0.3 * 2 * least(a.half, b.half)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, o) AS n FROM p) SELECT id, o AS faces, round(d2, 6) AS d2 FROM k WHERE n = 1""")
def facing_pairs(spark, sf_dir):
    return P.facing_pairs(walls(spark, sf_dir), 3.0).withColumn("d2", F.round("d2", 6))


@register(f"""WITH {POINTS_SQL}, p AS (SELECT a.id, b.id AS o, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2 FROM points a JOIN points b ON a.id <> b.id AND b.x > a.x AND abs(b.y - a.y) <= b.x - a.x),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, o) AS n FROM p WHERE isfinite(d2)) SELECT id, o AS neighbour FROM k WHERE n = 1""")
def directional_neighbor(spark, sf_dir):
    return R.directional_neighbour(points(spark, sf_dir).select("id", "x", "y"), 6.0)


@register(f"""WITH {POINTS_SQL}, s AS (SELECT id, x, unnest(range(8)) AS k FROM points), t AS (SELECT id, x, CAST(k AS INT) AS k, k / 7.0::DOUBLE AS t, 1 - k / 7.0::DOUBLE AS u FROM s)
SELECT id, k, round(u * u * u * x + 3 * u * u * t * (x + 1) + 3 * u * t * t * (x + 2) + t * t * t * (x + 4), 4) AS bx FROM t""")
def bezier_sample(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    curve = P.bezier([x, x + 1, x + 2, x + 4], [y, y + 1, y + 1, y], 7)
    return points(spark, sf_dir).select("id", F.posexplode(curve).alias("k", "p")).select("id", "k", F.col("p.x").alias("bx"))


@register(f"""WITH {POINTS_SQL}, t AS (SELECT id, x, y, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY id // 3 ORDER BY id))
SELECT id, round((x1 - x) * (y2 - y) - (y1 - y) * (x2 - x), 4) AS twice_area FROM t WHERE id % 3 = 0 AND x2 IS NOT NULL AND (x1 - x) * (y2 - y) - (y1 - y) * (x2 - x) > 0.5""")
def mesh_faces(spark, sf_dir):
    """Triangles that face up, with twice their area."""
    w = Window.partitionBy(F.floor(F.col("id") / 3)).orderBy("id")
    t = points(spark, sf_dir).select("id", "x", "y", *(F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("x", "y")))
    cross = (F.col("x1") - F.col("x")) * (F.col("y2") - F.col("y")) - (F.col("y1") - F.col("y")) * (F.col("x2") - F.col("x"))
    return t.where((F.col("id") % 3 == 0) & (cross > 0.5)).select("id", F.round(cross, 4).alias("twice_area"))


@register("WITH " + EDGES_SQL + """, v AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS k, ax, ay FROM (SELECT *, row_number() OVER () AS k FROM e)),
c AS (SELECT b.rid, b.k, (b.ax - a.ax) * (n.ay - b.ay) - (b.ay - a.ay) * (n.ax - b.ax) AS turn FROM v b JOIN v a ON a.rid = b.rid AND a.k = (b.k + 4) % 5 JOIN v n ON n.rid = b.rid AND n.k = (b.k + 1) % 5)
SELECT rid, CAST(k AS INT) AS k, turn > 0 AS convex FROM c""")
def ring_corners(spark, sf_dir):
    """Corners of rings with whether they are convex."""
    n = F.size("ring")
    rows = regions(spark).select("rid", "ring", F.posexplode("ring").alias("k", "p"))
    a, b = F.get("ring", (F.col("k") + n - 1) % n), F.get("ring", (F.col("k") + 1) % n)
    turn = (F.col("p.x") - a["x"]) * (b["y"] - F.col("p.y")) - (F.col("p.y") - a["y"]) * (b["x"] - F.col("p.x"))
    return rows.select("rid", "k", (turn > 0).alias("convex"))
