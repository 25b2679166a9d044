"""Queries of the smaller operators: totals, unions, legends, two-hop joins, openings, keyholes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roomflux.queries.schedule import SLOTS_SQL, STATE_SQL, states
from roomflux.queries.spatial import RINGS, regions
from roomflux.registry import register
from roomflux.tables import BOOKINGS_SQL, BOXES_SQL, POINTS_SQL, boxes, points, table

#: Order of the legend (a fixed dimension).
LEGEND = ("view", "click", "purchase", "signup", "error")


@register(f"WITH {BOOKINGS_SQL}, {SLOTS_SQL}, {STATE_SQL} SELECT state, count(*) AS rooms FROM states GROUP BY state")
def state_totals(spark, sf_dir):
    """The floor card: how many rooms are in each state."""
    return states(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("rooms"))


@register("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' UNION SELECT DISTINCT user_id FROM events WHERE value > 100")
def union_observations(spark, sf_dir):
    """Two observations united, so that neither is missed."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("user_id").union(e.where("value > 100").select("user_id")).distinct()


@register("SELECT event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS place, count(*) AS n FROM events GROUP BY ALL")
def ordered_legend(spark, sf_dir):
    legend = spark.createDataFrame(list(enumerate(LEGEND)), "place int, event_type string")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(legend), "event_type").select("event_type", "place", "n")  # five rows


@register("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority LIKE '1%'""")
def two_hop_join(spark, sf_dir):
    """Opening to filling (by a name prefix) to host: two equi-joins."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@register(f"""WITH {BOOKINGS_SQL}, {SLOTS_SQL}, {STATE_SQL} SELECT p_partkey, state, next_from FROM part LEFT JOIN states ON room = p_partkey % 30 WHERE p_size < 5""")
def late_enrichment(spark, sf_dir):
    """Cards that were open before the schedule came: the same rows with the state once it is there."""
    cards = table(spark, sf_dir, "part").where("p_size < 5").select("p_partkey", (F.col("p_partkey") % 30).cast("int").alias("room"))
    return cards.join(states(spark, sf_dir), "room", "left").select("p_partkey", "state", "next_from")


@register("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS term FROM orders ORDER BY term DESC LIMIT 6")
def known_terms(spark, sf_dir):
    """The last six terms, for a message about an unknown one."""
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("term")).distinct().orderBy(F.desc("term")).limit(6)


@register(f"""WITH {BOXES_SQL}, s AS (SELECT id, level * 100000 + y0 AS line, x0, x1 FROM boxes),
g AS (SELECT a.id AS a, b.id AS b, a.line, a.x1 AS s, b.x0 AS e FROM s a JOIN s b ON a.line = b.line AND a.id <> b.id AND b.x0 - a.x1 BETWEEN 1 AND 250)
SELECT a, b, CAST(e - s AS INT) AS gap FROM g WHERE NOT EXISTS (SELECT 1 FROM s k WHERE k.line = g.line AND k.id <> a AND k.id <> b AND k.x0 < g.e AND k.x1 > g.s)""")
def opening_gaps(spark, sf_dir):
    """Openings between segments of one line: a gap of allowed width that no third segment blocks, so one between the farthest end so far and the next start."""
    s = boxes(spark, sf_dir).select("id", (F.col("level") * 100_000 + F.col("y0")).alias("line"), "x0", "x1")
    before = Window.partitionBy("line").orderBy("x0", "x1", "id").rowsBetween(Window.unboundedPreceding, -1)
    free = s.select("line", F.max("x1").over(before).alias("s"), F.col("x0").alias("e")).where((F.col("e") - F.col("s")).between(1, 250))
    a, b = s.select(F.col("id").alias("a"), "line", F.col("x1").alias("s")), s.select(F.col("id").alias("b"), "line", F.col("x0").alias("e"))
    return free.join(a, ["line", "s"]).join(b, ["line", "e"]).select("a", "b", (F.col("e") - F.col("s")).cast("int").alias("gap"))


VERTEX_SQL = "v AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {k}, {x}::DOUBLE, {y}::DOUBLE)" for r, ring in RINGS for k, (x, y) in enumerate(ring)) + ") t(rid, k, x, y))"


@register(f"""WITH {VERTEX_SQL}, p AS (SELECT a.rid, a.k AS outer_k, b.k AS hole_k, (a.x - b.x - 8) * (a.x - b.x - 8) + (a.y - b.y) * (a.y - b.y) AS d FROM v a JOIN v b ON b.rid = a.rid - 1),
n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, outer_k, hole_k) AS r FROM p) SELECT rid, CAST(outer_k AS INT) AS outer_k, CAST(hole_k AS INT) AS hole_k FROM n WHERE r = 1""")
def keyhole(spark, sf_dir):
    """Where a hole is tied to its ring: the nearest pair of their vertices."""
    v = regions(spark).select("rid", F.posexplode("ring").alias("k", "p"))
    a = v.select("rid", F.col("k").alias("outer_k"), "p.x", "p.y")
    b = v.select((F.col("rid") + 1).alias("rid"), F.col("k").alias("hole_k"), F.col("p.x").alias("hx"), F.col("p.y").alias("hy"))
    dx, dy = F.col("x") - F.col("hx") - 8, F.col("y") - F.col("hy")
    best = F.min(F.struct((dx * dx + dy * dy).alias("d"), "outer_k", "hole_k"))
    return a.join(b, "rid").groupBy("rid").agg(best.alias("m")).select("rid", "m.outer_k", "m.hole_k")


@register(f"""WITH {POINTS_SQL}, w AS (SELECT id, x, y, CASE id % 2 WHEN 0 THEN 1.0 ELSE 0.0 END AS nx, CASE id % 2 WHEN 0 THEN 0.0 ELSE 1.0 END AS ny, 0.1 + label * 0.05 AS t FROM points)
SELECT id, round(x + nx * (t / 2 + 0.5), 4) AS ax, round(y + ny * (t / 2 + 0.5), 4) AS ay, round(x - nx * (t / 2 + 0.5), 4) AS bx, round(y - ny * (t / 2 + 0.5), 4) AS by_ FROM w""")
def bridge_sides(spark, sf_dir):
    """The two points in front of and behind a wall opening: half the wall and half a metre along its normal."""
    nx, ny = F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0), F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0)
    reach = (0.1 + F.col("label") * 0.05) / 2 + 0.5
    cols = [("ax", F.col("x") + nx * reach), ("ay", F.col("y") + ny * reach), ("bx", F.col("x") - nx * reach), ("by_", F.col("y") - ny * reach)]
    return points(spark, sf_dir).select("id", *(F.round(c, 4).alias(n) for n, c in cols))


@register("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3""")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("n", F.row_number().over(w)).where("n <= 3").select("c_nationkey", "c_custkey")
