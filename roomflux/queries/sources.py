"""Queries that read and write documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roomflux.functions import normalize as N
from roomflux.operators import lookup as L
from roomflux.operators import rank as R
from roomflux.operators import schedule as S
from roomflux.plans.lineage import shared_dir
from roomflux.queries.schedule import SLOTS_SQL, slots
from roomflux.registry import register
from roomflux.sources import documents as D
from roomflux.tables import BOOKINGS_SQL, bookings, table


@register(f"WITH {BOOKINGS_SQL}, {SLOTS_SQL} SELECT room, count(*) AS n, string_agg(concat_ws('/', day, t_from, t_to, mask, kind), ';' ORDER BY day, t_from, t_to, mask, kind) AS slots FROM slots GROUP BY room")
def json_documents(spark, sf_dir):
    """Rooms with their slots written as JSON documents and read back."""
    path = f"{shared_dir(spark)}/rooms-{uuid.uuid4().hex}"
    D.write_documents(S.nested_slots(slots(spark, sf_dir)), path)
    rooms = D.read_current(spark, [path], "room int, slots array<struct<day int, t_from int, t_to int, mask long, kind string>>", ["room", "slots"])
    return rooms.select("room", F.size("slots").cast("long").alias("n"), F.array_join(F.transform("slots", lambda s: F.concat_ws("/", s["day"], s["t_from"], s["t_to"], s["mask"], s["kind"])), ";").alias("slots"))


@register("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN length(url) END AS n, CASE WHEN page_id % 3 <> 0 THEN 'a;b' END AS mark FROM pages")
def embedded_script(spark, sf_dir):
    """A document that a script of the page assigns to a constant."""
    p = table(spark, sf_dir, "pages")
    script = F.concat(F.lit("<script>\nlet x = {};\nconst D = "), F.to_json(F.struct(F.length("url").alias("n"), F.lit("a;b").alias("mark"))), F.lit(";\nconst E = {};</script>"))
    page = F.when(F.col("page_id") % 3 != 0, F.concat("html", script)).otherwise(F.col("html"))
    found = D.embedded(page, "D", "n int, mark string")
    return p.select("page_id", found["n"].alias("n"), found["mark"].alias("mark"))


@register("""SELECT p_partkey, 'Á "' || p_name || '" & ' || chr(351) AS name, p_size * 1000 + 7 AS capacity, 'r' || p_partkey AS slug, 'https://rooms.example.org/terem/r' || p_partkey AS url, p_type || '|é' AS titles FROM part WHERE p_partkey % 5 <> 0""")
def register_cards(spark, sf_dir):
    """Cards of a register's pages: name, capacity, slug, url and the sorted titles."""
    p = table(spark, sf_dir, "part")
    card = F.concat(
        F.lit("<div><h2 class='x'> <b>&Aacute; &quot;"), F.col("p_name"), F.lit("&#34; &amp; &#x15F;</b> </h2>\n<h3>Férőhelyek: "), F.col("p_size").cast("string"), F.lit(" 007 fő</h3><i title=\"&eacute;\"></i><i title=\""),
        F.col("p_type"), F.lit("\"></i><i title=\"&eacute;\"></i><a href=\"https://rooms.example.org/terem/r"), F.col("p_partkey").cast("string"), F.lit("\">x</a></div>"),
    )
    page = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("<h4>a card:</h4>"), card)).otherwise("<h4>no card</h4>")
    rows = p.select("p_partkey", F.inline(D.cards(page)))
    titles = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("between", F.lit('title="([^"]+)"'), F.lit(1)), N.unescape)))
    name = F.trim(N.unescape(F.trim(N.strip_tags(F.col("name")))))
    return rows.select("p_partkey", name.alias("name"), F.regexp_replace("capacity", r"\s", "").cast("int").alias("capacity"), "slug", "url", F.array_join(titles, "|").alias("titles"))


KNOWN = "'red', 'blue'"


@register(f"""WITH l AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND a IN ({KNOWN}) THEN a END AS selected, CASE WHEN p_partkey % 3 <> 0 AND a IN ({KNOWN}) THEN a END AS origin,
  CASE WHEN p_partkey % 3 <> 0 AND a IN ({KNOWN}) THEN a END AS target, CASE WHEN p_partkey % 3 = 1 THEN 'lift' END AS via FROM l""")
def url_states(spark, sf_dir):
    """States of links: the short form, a start and a destination, a way; unknown codes are dropped, what follows a ? counts for nothing."""
    codes = spark.createDataFrame([("red",), ("blue",)], "code string")
    a = F.split_part("p_name", F.lit(" "), F.lit(1))
    p = table(spark, sf_dir, "part")
    link = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://m.example.org/?totem#"), a)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://m.example.org/#from="), a, F.lit("&to="), a, F.lit("&via=lift?utm_source=qr"))).otherwise(F.concat(F.lit("https://m.example.org/#to="), a, F.lit("&from="), a))
    names = ("selected", "origin", "target", "via")
    rows = p.select("p_partkey", *(x.alias(n) for x, n in zip(N.url_state(link), names, strict=True)))
    for n in names[:3]:
        known = F.broadcast(codes.select(F.col("code").alias(n), F.lit(True).alias("__known")))  # two rows
        rows = rows.join(known, n, "left").withColumn(n, F.when(F.col("__known"), F.col(n))).drop("__known")
    return rows.select("p_partkey", *names)


@register(f"""WITH {BOOKINGS_SQL}, u AS (SELECT kind || '/' || CAST(trunc(value) AS INT) % 9 AS subject, room, event_id FROM bookings),
f AS (SELECT subject, min(room * 100000000 + event_id) AS f FROM u GROUP BY 1) SELECT subject, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS code FROM f""")
def dictionary_by_use(spark, sf_dir):
    """Subjects numbered by their first use, rooms in natural order and then by place within the room."""
    b = bookings(spark, sf_dir)
    subject = F.concat("kind", F.lit("/"), (F.col("value").cast("int") % 9).cast("string"))
    rows = b.select(subject.alias("subject"), F.concat(F.col("room"), F.lit(".07")).alias("code"), "event_id")
    return L.dictionary_by_use(rows, "subject", [*R.natural_order(F.col("code")), F.col("event_id")])


@register()
def file_listing(spark, sf_dir):
    """The tables' files whose names start with ``part``, by name."""
    return D.listing(spark, sf_dir, "part")
