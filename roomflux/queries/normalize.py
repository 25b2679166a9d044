"""Queries that normalise codes, names, lists, times and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomflux.functions import normalize as N
from roomflux.operators import lookup as L
from roomflux.registry import register
from roomflux.tables import table


@register("SELECT o_orderkey, o_orderpriority, split_part(o_orderpriority, '-', 2) AS word FROM orders WHERE len(string_split(o_orderpriority, '-')) = 2 AND split_part(o_orderpriority, '-', 1) = '5'")
def segment_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    level, word = (N.segment(F.col("o_orderpriority"), k, "-", 2) for k in (0, 1))
    return o.where(level == "5").select("o_orderkey", "o_orderpriority", word.alias("word"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS segment FROM orders WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)")
def latest_segment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("segment"))
    return o.join(F.broadcast(o.agg(F.max("segment").alias("segment"))), "segment").select("o_orderkey", "segment")  # one row


@register("""SELECT p_partkey, x AS entry FROM (SELECT p_partkey, unnest(string_split_regex(p_name || ' , ' || p_brand || ';' || p_type || chr(10) || 'Brand#x;', '[,;' || chr(10) || ']')) AS raw FROM part), LATERAL (SELECT trim(raw) AS x) WHERE x LIKE 'Brand%'""")
def list_cell_explode(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cell = F.concat("p_name", F.lit(" , "), "p_brand", F.lit(";"), "p_type", F.lit("\nBrand#x;"))
    entries = N.list_cell(cell, "Brand")
    return p.where(F.size(entries) > 0).select("p_partkey", F.explode(entries).alias("entry"))


WEEKS_CELL = "concat_ws(',', {a}, ' ' || {b} || ' ', '1.0', {a}, 'x', '')"


@register(f"""WITH c AS (SELECT p_partkey, {WEEKS_CELL.format(a='p_size', b='p_partkey % 14')} AS cell FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(cell, ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]{{1,9}}')), lambda x: CAST(x AS INT)))), ' ') AS weeks FROM c""")
def week_list(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cell = F.concat_ws(",", "p_size", F.concat(F.lit(" "), F.col("p_partkey") % 14, F.lit(" ")), F.lit("1.0"), "p_size", F.lit("x"), F.lit(""))
    return p.select("p_partkey", F.array_join(F.transform(N.week_list(cell), lambda x: x.cast("string")), " ").alias("weeks"))


@register("SELECT dayname(o_orderdate) AS name, CAST(isodow(o_orderdate) AS INT) AS day, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'Nonday', NULL, count(*) FROM orders")
def weekday_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.explode(F.array(F.date_format("o_orderdate", "EEEE"), F.lit("Nonday"))).alias("name"))
    return o.groupBy("name", N.weekday(F.col("name")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


CODES = (("purchase", "x_LA1 EA2"), ("view", "gy_b"), ("click", "q EA1_GY"), ("error", "LEA x"))


@register("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'labor' WHEN 'view' THEN 'gyakorlat' WHEN 'click' THEN 'eloadas' ELSE 'egyeb' END AS kind FROM events""")
def classify_tokens(spark, sf_dir):
    code = F
    for kind, text in CODES:
        code = code.when(F.col("event_type") == kind, text)
    return table(spark, sf_dir, "events").select("event_id", N.classify(code.otherwise("none")).alias("kind"))


@register("SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minutes, CAST(NULL AS INT) AS odd FROM events")
def minutes_of_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", N.minutes_of_day(F.date_format("ts", "HH:mm:ss")).alias("minutes"), N.minutes_of_day(F.lit("noon")).alias("odd"))


@register("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'F' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN 1 THEN CAST(p_size % 9 AS VARCHAR) || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'a' WHEN 2 THEN 'Audmax' END AS number FROM part WHERE p_partkey % 8 <> 4 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 8 = 4""")
def normalize_number(spark, sf_dir):
    two = F.lpad(F.col("p_size").cast("string"), 2, "0")
    raw = F.when(F.col("p_partkey") % 8 == 4, F.concat(F.lit("f"), two)).when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" F"), two)).when(F.col("p_partkey") % 4 == 1, F.concat((F.col("p_size") % 9).cast("string"), two, F.lit(" A"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("audmax 1."), two)).otherwise(F.lit("<none>"))
    return table(spark, sf_dir, "part").select("p_partkey", N.door_number(raw).alias("number"))


@register("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'F' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN 1 THEN 'Audmax' ELSE '2.' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS short,
  CASE p_partkey % 3 WHEN 0 THEN 'F' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN 1 THEN 'AUDMAX' ELSE 'LABOR 2.' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS register FROM part""")
def code_names(spark, sf_dir):
    two = F.lpad(F.col("p_size").cast("string"), 2, "0")
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("BA.F."), two)).when(F.col("p_partkey") % 3 == 1, F.lit("BA.AUDMAX")).otherwise(F.concat(F.lit("BA.2."), two))
    short, register_name = N.code_names(code)
    return table(spark, sf_dir, "part").select("p_partkey", short.alias("short"), register_name.alias("register"))


UNESCAPE_SQL = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@register(f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2)) AS raw FROM pages)
SELECT page_id, href, {UNESCAPE_SQL.format(x="regexp_replace(raw, '<[^>]*>', '', 'g')")} AS title FROM l""")
def html_links(spark, sf_dir):
    card = F.lit(r'(?s)<a href="([^"]*)">(.*?)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", card, F.lit(1)).alias("href"), F.regexp_extract_all("html", card, F.lit(2)).alias("raw"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.inline(both)).toDF("page_id", "href", "raw")
    return rows.select("page_id", "href", N.unescape(N.strip_tags(F.col("raw"))).alias("title"))


@register(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS tags, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h, length(html) AS n FROM pages)
SELECT page_id, {UNESCAPE_SQL.format(x="regexp_replace(h, '<[^>]*>', '', 'g')")} AS name, array_to_string(list_sort(list_distinct(tags)), '|') AS tags, n AS capacity FROM l""")
def html_cards(spark, sf_dir):
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))))
    name = N.unescape(N.strip_tags(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.array_join(tags, "|").alias("tags"), F.length("html").cast("long").alias("capacity"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def embedded_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages""")
def url_params(spark, sf_dir):
    url = F.col("url")
    fragment = F.regexp_extract(url, "#(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), N.query_parameter(url, "page").alias("page"), N.query_parameter(url, "ref").alias("ref"), F.when(fragment != "", fragment).alias("fragment"))


@register(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) AS dest, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS raw FROM pages)
SELECT page_id, dest, coalesce(CASE WHEN raw IN ('x', 'y') THEN raw END, 'OAX1A02') AS origin FROM p""")
def default_origin(spark, sf_dir):
    """The origin that a link names, if it is a known code; else the reception."""
    known = spark.createDataFrame([("x",), ("y",)], "code string")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1).alias("dest"), N.query_parameter(F.col("url"), "ref").alias("raw"))
    return p.join(F.broadcast(known), p.raw == known.code, "left").select("page_id", "dest", F.coalesce("code", F.lit("OAX1A02")).alias("origin"))  # two rows


REASON = "CASE WHEN l_quantity < 5 THEN 'few' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag = 'R' AND l_tax = 0 THEN 'returned' END"


@register(f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def reject_reasons(spark, sf_dir):
    reason = F.when(F.col("l_quantity") < 5, "few").when(F.col("l_discount") > 0.08, "discount").when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0), "returned").otherwise("kept")
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def header_project(spark, sf_dir):
    return L.project_by_header(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@register("""SELECT code, number, func FROM (SELECT c_name AS code, CAST(c_nationkey AS VARCHAR) AS number, c_mktsegment AS func FROM customer UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR), 'SUPPLIER' FROM supplier) WHERE regexp_full_match(code, '(Customer|Supplier)#0*[1-9][0-9]?')""")
def multi_source_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("code"), F.col("c_nationkey").cast("string").alias("number"), F.col("c_mktsegment").alias("func"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("code"), F.col("s_nationkey").cast("string").alias("number"), F.lit("SUPPLIER").alias("func"))
    return c.unionByName(s).where(F.col("code").rlike("^(Customer|Supplier)#0*[1-9][0-9]?$"))


@register(r"""SELECT o_orderkey, regexp_extract(f, '([0-9]{4})-([0-9]{2})-([0-9])', 1) || regexp_extract(f, '([0-9]{4})-([0-9]{2})-([0-9])', 2) || regexp_extract(f, '([0-9]{4})-([0-9]{2})-([0-9])', 3) AS term, regexp_extract(f, '-([A-Z]{2,5})-kurzus', 1) AS faculty
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-' || CASE o_orderstatus WHEN 'F' THEN 'IK' WHEN 'O' THEN 'TTK' ELSE 'x' END || '-kurzus.xlsx' AS f FROM orders)""")
def name_tokens(spark, sf_dir):
    f = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.when(F.col("o_orderstatus") == "F", "IK").when(F.col("o_orderstatus") == "O", "TTK").otherwise("x"), F.lit("-kurzus.xlsx"))
    term = F.concat(*(F.regexp_extract(f, "([0-9]{4})-([0-9]{2})-([0-9])", k) for k in (1, 2, 3)))
    return table(spark, sf_dir, "orders").select("o_orderkey", term.alias("term"), F.regexp_extract(f, "-([A-Z]{2,5})-kurzus", 1).alias("faculty"))


SPACES = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@register(f"SELECT doc_id, md5(x) AS squashed, length(x) AS n FROM (SELECT doc_id, trim(regexp_replace(replace(text, '. ', '.' || chr(160) || ' '), '{SPACES}', ' ', 'g')) AS x FROM documents)")
def normalize_text(spark, sf_dir):
    own = N.squash(F.replace(F.col("text"), F.lit(". "), F.lit(".\u00a0 ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(own.cast("binary")).alias("squashed"), F.length(own).cast("long").alias("n"))


#: First rule that a name meets.
ICONS = [("red", "lift"), ("small", "accessible"), ("ring$", "female"), ("widget$", "male"), ("blue", "wc")]


@register("""SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 'lift' WHEN p_name LIKE '%small%' THEN 'accessible' WHEN p_name LIKE '%ring' THEN 'female' WHEN p_name LIKE '%widget' THEN 'male' WHEN p_name LIKE '%blue%' THEN 'wc' END AS icon FROM part""")
def icon_rules(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.icon(F.col("p_name"), ICONS).alias("icon"))


@register("""WITH paired AS (SELECT p_partkey, p_brand AS number FROM part WHERE p_size < 10) SELECT p.p_partkey, CASE WHEN number IS NOT NULL THEN number
  WHEN regexp_matches(CAST(p_size AS VARCHAR), '^[1-4][0-9]$') AND p_type IN ('SMALL', 'LARGE') THEN p_type || '.' || p_size ELSE CAST(p_size AS VARCHAR) END AS label FROM part p LEFT JOIN paired USING (p_partkey)""")
def label_text(spark, sf_dir):
    """The paired number; else the short code, or the full one where the short could be taken for a number."""
    p = table(spark, sf_dir, "part")
    paired = p.where("p_size < 10").select("p_partkey", F.col("p_brand").alias("number"))
    short = F.col("p_size").cast("string")
    like = short.rlike("^[1-4][0-9]$") & F.col("p_type").isin("SMALL", "LARGE")
    label = F.when(F.col("number").isNotNull(), F.col("number")).when(like, F.concat("p_type", F.lit("."), short)).otherwise(short)
    return p.join(paired, "p_partkey", "left").select("p_partkey", label.alias("label"))


@register("SELECT c_custkey, c_mktsegment, c_mktsegment IN ('BUILDING', 'MACHINERY') AS dimmed FROM customer")
def visibility_flag(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("dimmed"))


@register("""SELECT p_partkey, rtrim('https://rooms.example.org//', '/') || '/#from=' || p_brand AS link, CAST(row_number() OVER (ORDER BY p_size, coalesce(p_brand, ''), p_partkey) AS INT) AS place FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_size IN (1, 2, 3, 5)""")
def deep_links(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").where(F.col("p_type").isin("SMALL", "PROMO") & F.col("p_size").isin(1, 2, 3, 5))
    base = F.regexp_replace(F.lit("https://rooms.example.org//"), "/+$", "")
    place = F.row_number().over(Window.orderBy("p_size", F.coalesce("p_brand", F.lit("")), "p_partkey"))
    return p.select("p_partkey", F.concat(base, F.lit("/#from="), "p_brand").alias("link"), place.alias("place"))
