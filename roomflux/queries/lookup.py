"""Queries of lookups, duplicates and overlays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roomflux.operators import lookup as L
from roomflux.operators import rank as R
from roomflux.registry import register
from roomflux.tables import BOOKINGS_SQL, bookings, table


@register("""WITH reg AS (SELECT unnest(string_split(name, ' - ')) AS k, name, value, pos FROM (
  SELECT 'BRAND#' || n_nationkey || ' - Brand#' || (n_nationkey + 12) AS name, n_name AS value, n_nationkey AS pos FROM nation WHERE n_nationkey % 3 <> 0)),
last AS (SELECT upper(trim(k)) AS k, arg_max(name, pos) AS name, arg_max(value, pos) AS value FROM reg GROUP BY 1)
SELECT p_partkey, p_brand, name, value FROM part LEFT JOIN last ON upper(p_brand) = k""")
def left_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    key = F.col("n_nationkey")
    register_rows = n.select(F.concat(F.lit("BRAND#"), key, F.lit(" - Brand#"), key + 12).alias("name"), F.col("n_name").alias("value"), key.alias("pos"))
    return L.left_lookup(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), register_rows, "p_brand").select("p_partkey", "p_brand", "r.name", "r.value")


@register("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS listed FROM customer""")
def semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("listed", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("listed", F.lit(False)))


@register("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    return L.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ["user_id"], F.col("event_id")).drop("event_id")


@register(f"WITH {BOOKINGS_SQL} SELECT room, day, t_from, t_to, week, kind, count(*) - 1 AS dropped FROM bookings GROUP BY ALL")
def distinct_rows(spark, sf_dir):
    return bookings(spark, sf_dir).groupBy("room", "day", "t_from", "t_to", "week", "kind").agg((F.count(F.lit(1)) - 1).alias("dropped"))


@register("WITH p AS (SELECT p_partkey, p_name || p_brand || p_size AS number FROM part) SELECT p_partkey, number FROM p WHERE number IN (SELECT number FROM p GROUP BY number HAVING count(DISTINCT p_partkey) = 1)")
def ambiguous_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_brand", F.col("p_size").cast("string")).alias("number"))
    return L.unambiguous(p, "number", "p_partkey").select("p_partkey", "number")


@register(f"""WITH {BOOKINGS_SQL}, c AS (SELECT room, kind, count(*) AS n, min(event_id) AS f FROM bookings GROUP BY ALL)
SELECT room, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""")
def mode_per_group(spark, sf_dir):
    return L.mode_per_group(bookings(spark, sf_dir), "room", "kind", "event_id")


@register("WITH f AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1) SELECT user_id, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS code FROM f")
def dictionary_encode(spark, sf_dir):
    return L.dictionary_encode(table(spark, sf_dir, "events"), "user_id", "event_id")


@register("""WITH b AS (SELECT n_nationkey AS k, n_nationkey * 3 % 25 AS number FROM nation), l AS (SELECT n_nationkey AS k, n_nationkey % 7 AS number FROM nation WHERE n_nationkey % 4 = 1),
m AS (SELECT k, coalesce(l.number, b.number) AS number, l.number IS NOT NULL AS local FROM b FULL JOIN l USING (k))
SELECT k, number, local FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY local DESC, k) AS n FROM m) WHERE n = 1""")
def override_layer(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    base = n.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 3 % 25).alias("number"))
    local = n.where("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 7).alias("number"))
    return L.override_layer(base, local, "k", "number")


@register("""(SELECT DISTINCT o_custkey AS k, 'new' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0))
UNION ALL (SELECT c_custkey, 'stale' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def two_way_except(spark, sf_dir):
    observed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return L.two_way_except(observed, table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), "k")


ROOM_CODE = "CASE WHEN p_partkey % 5 = 0 THEN 'F' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN p_partkey % 5 = 1 THEN 'Audmax' ELSE p_partkey % 5 || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0') END"


def room_codes(spark, sf_dir):
    two = F.lpad(F.col("p_size").cast("string"), 2, "0")
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, F.concat(F.lit("F"), two)).when(k == 1, F.lit("Audmax")).otherwise(F.concat(k.cast("string"), F.lit("."), two))
    return table(spark, sf_dir, "part").select(code.alias("code")).distinct()


@register(f"""WITH c AS (SELECT DISTINCT {ROOM_CODE} AS code FROM part)
SELECT code, CAST(row_number() OVER (ORDER BY CASE WHEN code LIKE 'F%' THEN -1 ELSE coalesce(TRY_CAST(nullif(regexp_extract(code, '^([0-9]+)\\.', 1), '') AS INT), 99) END, coalesce(TRY_CAST(nullif(regexp_extract(code, '([0-9]+)$', 1), '') AS INT), 99), code) AS INT) AS place FROM c""".replace("\\\\", "\\"))
def natural_order(spark, sf_dir):
    c = room_codes(spark, sf_dir)
    return c.select("code", F.row_number().over(Window.orderBy(*R.natural_order(F.col("code")))).alias("place"))


@register(f"""WITH c AS (SELECT DISTINCT {ROOM_CODE} AS code FROM part), k AS (SELECT code, replace(upper(code), '.', '') AS own FROM c)
SELECT code, CASE WHEN own = '31' THEN 0 WHEN own LIKE '31%' THEN 1 ELSE 2 END AS rank FROM k WHERE own LIKE '%31%'""")
def search_rank(spark, sf_dir):
    return R.search_rank(room_codes(spark, sf_dir), F.col("code"), "BA.3.1")


@register("""SELECT coalesce(f.user_id, c.user_id) AS user_id, coalesce(f.value, c.value) AS value, CASE WHEN f.value IS NOT NULL THEN 'fresh' ELSE 'cached' END AS origin FROM
  (SELECT user_id, max(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1) f FULL JOIN (SELECT user_id, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1) c USING (user_id)""")
def fresh_or_cached(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fresh, cached = (e.where(f"ts {op} timestamp'2024-01-29'").groupBy("user_id").agg(F.max("value").alias("value")) for op in (">=", "<"))
    return L.fresh_or_cached(fresh, cached, "user_id", "value")


@register("""SELECT c_custkey, c_nationkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name) AS level FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def inherit_parent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("level"))
    return L.inherit_parent(c, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("level")), "c_nationkey", "level")


@register("""WITH RECURSIVE o AS (SELECT s_nationkey AS grp, s_name || ': ' || s_nationkey AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name || ': ' || s_nationkey) AS r FROM supplier),
n AS (SELECT grp, max(r) AS n FROM o GROUP BY grp),
k AS (SELECT grp, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS lines, '' AS line FROM n
  UNION ALL SELECT k.grp, o.r, CASE WHEN k.line <> '' AND length(k.line) + 2 + length(x) > 100 THEN list_append(k.lines, k.line) ELSE k.lines END,
    CASE WHEN k.line <> '' AND length(k.line) + 2 + length(x) <= 100 THEN k.line || ', ' || x ELSE x END FROM k JOIN o ON o.grp = k.grp AND o.r = k.r + 1),
w AS (SELECT k.grp, list_append(lines, line) AS lines FROM k JOIN n ON n.grp = k.grp AND n.n = k.r), t AS (SELECT grp, lines, unnest(range(len(lines))) AS i FROM w)
SELECT grp, CAST(i AS INT) AS line_no, lines[i + 1] AS line FROM t""")
def line_pack(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return L.line_pack(s, F.col("s_nationkey"), F.concat("s_name", F.lit(": "), F.col("s_nationkey").cast("string")), 100)


@register("SELECT n_regionkey, string_agg(n_name || ' = ' || n_nationkey, chr(10) ORDER BY n_name) AS pairs FROM nation GROUP BY 1")
def pair_list(spark, sf_dir):
    pair = F.concat_ws(" = ", "n_name", "n_nationkey")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(pair)), "\n").alias("pairs"))


@register("""SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'returned', count(*) FILTER (l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'quantity', sum(l_quantity) FROM lineitem""")
def run_report(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.count_distinct("l_orderkey").cast("double").alias("orders"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returned"), F.sum("l_quantity").alias("quantity"))
    return one.unpivot([], ["rows", "orders", "returned", "quantity"], "metric", "value")


@register("""WITH e AS (SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) / 25 AS err FROM lineitem)
SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (err <= 0.05), arg_min(l_linenumber, err * 1000 + l_linenumber)) AS choice, CAST(max(CASE WHEN err <= 0.05 THEN 1 ELSE 0 END) AS INT) AS within FROM e GROUP BY 1""")
def first_ok_else_best(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").withColumn("err", F.abs(F.col("l_quantity") - 25) / 25)
    return L.first_ok_else_best(e, "l_orderkey", F.col("err") <= 0.05, F.col("l_linenumber"), F.col("err") * 1000 + F.col("l_linenumber"), "l_linenumber")


@register("""WITH e AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), a AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 3 THEN -1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 17 <> 5)
SELECT k, e.v AS expected, a.v AS actual FROM e FULL JOIN a USING (k) WHERE e.v IS DISTINCT FROM a.v""")
def ordinal_diff(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return L.ordinal_diff(s, s.where("k % 17 <> 5").withColumn("v", F.when(F.col("k") % 10 == 3, -1).otherwise(F.col("v"))), "k", "v")
