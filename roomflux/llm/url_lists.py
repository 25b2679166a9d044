"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

An event (list, kind, value, on, action) adds or removes an entry. Events of one entry, by date, are turned into intervals
[valid_from, valid_to): a state holds until the next event. A capture is looked up by each key that an entry could have: its
host, each parent domain of the host, and the host with each leading run of its path that is no deeper than the deepest
entry. That makes the as-of join an equi-join
on the key with the interval as residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, HOST, 1), "^.*@", ""), ":[0-9]*$", ""))


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, value, action, valid_from, valid_to (null: still holds). Of several events on one day a removal stands."""
    day = events.groupBy("list", "kind", "value", "on").agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    order = Window.partitionBy("list", "kind", "value").orderBy("on")
    return day.select("list", "kind", "value", "action", F.col("on").alias("valid_from"), F.lead("on").over(order).alias("valid_to"))


def deepest(events: DataFrame) -> DataFrame:
    """One row: ``depth``, the most path segments that a prefix entry names."""
    return events.where("kind = 'prefix'").agg(F.coalesce(F.max(F.size(F.split("value", "/"))) - 1, F.lit(0)).alias("depth"))


def lookup_keys(host: Column, path: Column, depth: Column) -> Column:
    """(kind, value) of the entries of at most ``depth`` path segments that would match a capture."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("value")))
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, depth)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")).alias("value")))
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"))), domains, F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Each capture (capture_id, url, fetched) with host, blocked, n_block, n_allow and the first matching entry that decided.

    A capture is blocked if an entry of list ``block`` is active at ``fetched`` and none of list ``allow`` is. A null or odd
    url has an empty host and matches nothing, a null fetch time matches nothing; repeated captures (equal id, url and time)
    are kept as often as they come; empty tables give an empty or an unblocked result; further columns are ignored.
    """
    rows = captures.select("capture_id", "url", "fetched").groupBy("capture_id", "url", "fetched").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")))
    dated = rows.where("host <> '' and fetched is not null").crossJoin(F.broadcast(deepest(events)))  # one row
    keys = dated.select("capture_id", "url", "fetched", F.inline(lookup_keys(F.col("host"), F.col("path"), F.col("depth"))))
    active = intervals(events).where("action = 'add'")
    current = F.col("k.fetched") >= F.col("e.valid_from")
    current &= F.col("e.valid_to").isNull() | (F.col("k.fetched") < F.col("e.valid_to"))
    hits = keys.alias("k").join(active.alias("e"), (F.col("k.kind") == F.col("e.kind")) & (F.col("k.value") == F.col("e.value")) & current)
    hits = hits.select("k.capture_id", "k.url", "k.fetched", "e.list", F.concat_ws(":", "e.list", "e.kind", "e.value").alias("entry"))
    met = hits.groupBy("capture_id", "url", "fetched").agg(F.count_if(F.col("list") == "block").alias("n_block"), F.count_if(F.col("list") == "allow").alias("n_allow"), F.min("entry").alias("entry"))
    out = rows.alias("r").join(met.alias("m"), F.col("r.capture_id").eqNullSafe(F.col("m.capture_id")) & (F.col("r.url") == F.col("m.url")) & (F.col("r.fetched") == F.col("m.fetched")), "left")
    zero = F.lit(0).cast("long")
    out = out.select("r.capture_id", "r.host", "r.fetched", F.coalesce("m.n_block", zero).alias("n_block"), F.coalesce("m.n_allow", zero).alias("n_allow"), F.col("m.entry").alias("entry"), "r.times")
    out = out.withColumn("blocked", (F.col("n_block") > 0) & (F.col("n_allow") == 0))
    return out.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "__again")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the ``pages`` table, which has no fetch time: the day follows from page_id."""
    day = F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated lists over the hosts and first path segments of ``pages``, by a fixed rule on their letters."""
    seen = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", PATH, 1).alias("path")).where("host <> ''").withColumn("top", F.split_part("path", F.lit("/"), F.lit(2))).select("host", "top").distinct()

    def number(x: Column) -> Column:
        return F.ascii(x) * 7 + F.ascii(F.substring(x, 2, 1)) * 3 + F.length(x) * 11

    start = F.lit("2024-01-01").cast("date")
    values = [
        ("block", "host", F.col("host"), 0, 3, 200),
        ("allow", "prefix", F.concat("host", F.lit("/"), F.col("top")), 1, 4, 260),
        ("block", "prefix", F.concat("host", F.lit("/"), F.col("top")), 2, 5, 150),
    ]
    parts = []
    for name, kind, value, rest, of, spread in values:
        own = seen.where(F.lit(True) if kind == "host" else F.col("top") != "").select(value.alias("value")).distinct()
        own = own.where(number(F.col("value")) % of == rest % of).withColumn("n", number(F.col("value")) % spread)
        steps = F.array(*(F.struct(F.date_add(start, F.col("n") + gap).alias("on"), F.lit(action).alias("action")) for gap, action in ((0, "add"), (60, "remove"), (120, "add"))))
        parts.append(own.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "value", F.inline(steps)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PAGE_SQL = r"""
WITH captures AS (
  SELECT page_id AS capture_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INT) AS fetched,
    coalesce(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
seen AS (SELECT DISTINCT host, split_part(path, '/', 2) AS top FROM captures WHERE host <> ''),
named AS (
  SELECT DISTINCT 'block' AS list, 'host' AS kind, host AS value, 0 AS rest, 3 AS m, 200 AS spread FROM seen
  UNION ALL SELECT DISTINCT 'allow', 'prefix', host || '/' || top, 1, 4, 260 FROM seen WHERE top <> ''
  UNION ALL SELECT DISTINCT 'block', 'prefix', host || '/' || top, 2, 5, 150 FROM seen WHERE top <> ''),
numbered AS (SELECT *, ascii(value) * 7 + (CASE WHEN length(value) > 1 THEN ascii(substr(value, 2, 1)) ELSE 0 END) * 3 + length(value) * 11 AS num FROM named),
active AS (
  SELECT list, kind, value, DATE '2024-01-01' + CAST(num % spread + gap AS INT) AS valid_from,
    CASE WHEN gap = 0 THEN DATE '2024-01-01' + CAST(num % spread + 60 AS INT) END AS valid_to
  FROM numbered, (VALUES (0), (120)) g(gap) WHERE num % m = rest),
hits AS (
  SELECT c.capture_id, a.list, a.list || ':' || a.kind || ':' || a.value AS entry FROM captures c JOIN active a
  ON ((a.kind = 'host' AND a.value = c.host)
    OR (a.kind = 'prefix' AND split_part(c.path, '/', 2) <> '' AND a.value = c.host || '/' || split_part(c.path, '/', 2)))
  AND c.fetched >= a.valid_from AND (a.valid_to IS NULL OR c.fetched < a.valid_to)),
met AS (SELECT capture_id, count(*) FILTER (list = 'block') AS n_block, count(*) FILTER (list = 'allow') AS n_allow, min(entry) AS entry FROM hits GROUP BY 1)
SELECT c.capture_id, c.host, c.fetched, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow, entry,
  coalesce(n_block, 0) > 0 AND coalesce(n_allow, 0) = 0 AS blocked
FROM captures c LEFT JOIN met USING (capture_id)
"""
