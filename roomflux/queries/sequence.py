"""Queries over ordered events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roomflux.operators import sequence as Q
from roomflux.registry import register
from roomflux.tables import table


#: Event ids to a block.
IDS = 1 << 16


def events(spark, sf_dir):
    """Events with blocks that grow with an order: ``block``, the day, with (ts, event_id), and ``ids`` with event_id."""
    return table(spark, sf_dir, "events").withColumn("block", F.to_date("ts")).withColumn("ids", F.floor(F.col("event_id") / IDS))


@register("SELECT * FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_value FROM conversations) WHERE next_value IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    return Q.consecutive_pairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")


@register("""WITH m AS (SELECT *, row_number() OVER w AS place, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS value, count(*) AS steps, CAST(min(place) AS INT) AS first_place, CAST(max(place) AS INT) AS last_place FROM r GROUP BY user_id, run""")
def merge_runs(spark, sf_dir):
    return Q.runs(events(spark, sf_dir), ["user_id"], ["event_id"], "event_type", "ids")


@register("SELECT user_id, count(*) FILTER (event_type <> was) AS changes FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) GROUP BY 1")
def transition_count(spark, sf_dir):
    return Q.transitions(events(spark, sf_dir), "user_id", ["event_id"], "event_type", "ids")


@register("""WITH s AS (SELECT user_id, event_id, value > 50 AS on_, row_number() OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT * FROM (SELECT *, lag(on_) OVER (PARTITION BY user_id ORDER BY step) AS was FROM s) WHERE on_ <> was),
f AS (SELECT *, coalesce(step - lag(step) OVER w <= 2 OR step - lag(step, 2) OVER w <= 6, false) AS fl FROM t WINDOW w AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, count(*) AS toggles, count(*) FILTER (fl) AS flickers FROM f GROUP BY 1""")
def flicker(spark, sf_dir):
    return Q.flicker(events(spark, sf_dir).withColumn("on", F.col("value") > 50), "user_id", "event_id", "on")


@register("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_mark FROM events""")
def since_last(spark, sf_dir):
    return Q.since_last(events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type") == "click", "block").select("event_id", "last_mark")


@register("""SELECT user_id, max(g) AS gap_us FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events) GROUP BY 1""")
def max_gap(spark, sf_dir):
    return Q.gaps(events(spark, sf_dir), "user_id", "ts", "event_id", "block").groupBy("user_id").agg(F.max("gap_us").alias("gap_us"))


@register("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, s.n""")
def idle_sessions(spark, sf_dir):
    return Q.sessions(events(spark, sf_dir), "user_id", "ts", "6 hours")


@register("""SELECT event_id, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value <= 10 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS state FROM events""")
def hysteresis(spark, sf_dir):
    return Q.hysteresis(events(spark, sf_dir), "user_id", ["event_id"], "value", 10.0, 60.0, "ids").select("event_id", "state")


DECIDED = "CASE WHEN value > 80 THEN 'rotate' WHEN event_type = 'purchase' THEN 'tilt' WHEN event_type = 'signup' THEN 'zoom' END"


@register(f"""SELECT user_id, CAST(ts AS DATE) AS d, coalesce(arg_min({DECIDED}, event_id) FILTER ({DECIDED} IS NOT NULL), 'none') AS kind FROM events GROUP BY ALL""")
def first_decisive(spark, sf_dir):
    kind = F.when(F.col("value") > 80, "rotate").when(F.col("event_type") == "purchase", "tilt").when(F.col("event_type") == "signup", "zoom")
    return Q.first_decisive(events(spark, sf_dir).withColumn("d", F.to_date("ts")), ["user_id", "d"], F.col("event_id"), kind)


@register("""SELECT event_id FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS wait FROM events) WHERE wait IS NULL OR wait >= 3600000000""")
def debounce(spark, sf_dir):
    return Q.debounce(events(spark, sf_dir), "user_id", "ts", "event_id", 3_600_000_000, "block").select("event_id")


@register("""SELECT date_trunc('hour', ts) AS frame, arg_max(value, event_id) FILTER (user_id % 2 = 0) AS first_pointer, arg_max(value, event_id) FILTER (user_id % 2 = 1) AS second_pointer FROM events GROUP BY 1""")
def frame_pairing(spark, sf_dir):
    return Q.frame_pairing(events(spark, sf_dir), F.date_trunc("hour", "ts"), F.col("user_id") % 2, "value", "event_id")


@register("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events")
def history_back(spark, sf_dir):
    return Q.history_back(events(spark, sf_dir), "user_id", ["event_id"], "event_type", "ids").select("event_id", "back")


@register("""SELECT event_type, count(*) AS n, round(median(value), 6) AS median, quantile_disc(value, 0.5) AS lower_median FROM events GROUP BY 1""")
def median_stats(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 6).alias("median"), F.expr("percentile_disc(0.5) within group (order by value)").alias("lower_median"))


@register("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, round(max(v) FILTER (k = n * 999 // 1000) / (max(v) FILTER (k = n * 998 // 1000) - max(v) FILTER (k = n * 2 // 1000)), 6) AS ratio FROM r GROUP BY 1""")
def percentile_ratio(spark, sf_dir):
    """Values at index floor(n p) of the sorted list, by counts of distinct values: no group is ever sorted as a whole in one task."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_extendedprice").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    bucket = F.floor(F.col("v") / 1000)
    sums = counts.groupBy("l_returnflag", bucket.alias("b")).agg(F.sum("c").alias("c"))
    upto = sums.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("l_returnflag").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("l_returnflag"))).drop("c")
    rows = counts.withColumn("b", bucket).join(upto, ["l_returnflag", "b"])
    inner = Window.partitionBy("l_returnflag", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lo", F.col("before") + F.coalesce(F.sum("c").over(inner), F.lit(0)))

    def at(num: int):
        k = F.floor(F.col("n") * num / 1000)
        return F.max(F.when((F.col("lo") <= k) & (k < F.col("lo") + F.col("c")), F.col("v")))

    return rows.groupBy("l_returnflag").agg(F.round(at(999) / (at(998) - at(2)), 6).alias("ratio"))


@register("SELECT l_shipdate::DATE AS d, round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def share_within(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.round(F.avg((F.col("l_discount") < 0.05).cast("double")), 6).alias("share"))


@register("SELECT round(l_tax, 2) AS z, count(*) AS n, round(sum(l_quantity), 2) AS area FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING sum(l_quantity) >= 100")
def round_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.round("l_tax", 2).alias("z")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("area"))
    return rows.where("area >= 100")


@register("""SELECT p_partkey, CASE WHEN e <= 0.03 THEN 'exact' WHEN e <= 0.05 THEN 'near' WHEN p_size < 24.25 THEN 'truncated' ELSE 'off' END AS class FROM (SELECT p_partkey, p_size, abs(p_size - 25) / 25.0 AS e FROM part)""")
def tolerance_class(spark, sf_dir):
    e = F.abs(F.col("p_size") - 25) / 25.0
    return table(spark, sf_dir, "part").select("p_partkey", F.when(e <= 0.03, "exact").when(e <= 0.05, "near").when(F.col("p_size") < 24.25, "truncated").otherwise("off").alias("class"))


@register("""WITH i AS (SELECT user_id, value * 10 + event_id % 977 - 8 AS s, value * 10 + event_id % 977 + 3 + 8 AS e FROM events),
m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS fresh FROM i),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, round(min(s), 4) AS s, round(max(e), 4) AS e, count(*) AS parts FROM n GROUP BY user_id, island""")
def coalesce_gaps(spark, sf_dir):
    start = F.col("value") * 10 + F.col("event_id") % 977
    out = Q.coalesce_gaps(events(spark, sf_dir), "user_id", start, start + 3, 8.0)
    return out.select("user_id", "island", F.round("s", 4).alias("s"), F.round("e", 4).alias("e"), "parts")


@register("""SELECT event_type, CAST(ts AS DATE) AS d, grouping(event_type) * 2 + grouping(CAST(ts AS DATE)) AS g, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))""")
def extension_rollup(spark, sf_dir):
    """Extension: subtotals."""
    return events(spark, sf_dir).withColumn("d", F.to_date("ts")).rollup("event_type", "d").agg((F.grouping("event_type") * 2 + F.grouping("d")).cast("long").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def extension_stream_windows(spark, sf_dir):
    """Extension: event-time windows of a stream over the events, with a watermark."""
    from roomflux.streaming import windows

    return windows.run_daily(spark, f"{sf_dir}/events.parquet")


@register("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, s.n""")
def extension_stream_sessions(spark, sf_dir):
    """Extension: the idle sessions as a stream."""
    from roomflux.streaming import windows

    return windows.run_sessions(spark, f"{sf_dir}/events.parquet")
