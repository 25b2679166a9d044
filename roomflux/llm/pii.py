"""Personal data: base patterns, and identifiers that they miss, found by bootstrapped contextual extraction.

Base matches are the seeds. Identifier-like tokens (those with a digit or an @, less a label up to : or =) and runs of
neighbouring digit groups that no base match covers are instances to judge. The words around a token are its lexical patterns: the two words before it, and the words on either side. Patterns
and instances form a graph; Spark scores it in rounds: a pattern's score for a kind is the (smoothed) share of its instances
known or believed to be of that kind, an instance's is that of its best pattern. Instances of high score whose shape suits
the kind are added. The graph holds words and tokens, not texts, and is summed before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomflux.llm.spans import KEY, likely, listed, of_kind, text_key, with_matches
from roomflux.plans.lineage import materialize

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, in linear form: the same leftmost non-overlapping matches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an @, less the marks around it.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Neighbouring digit groups that start a token, a label up to : or = before them allowed.
JOINED = r"(?<!\S)(?:[^\s0-9@:=]*+[:=])*+[+(]?+[0-9][0-9().-]*+(?:\x20[(]?+[0-9][0-9().-]*+)++"
#: A label glued to a token.
LABEL = r"(?:[^0-9@]*[:=])?"
ROUNDS = 2
#: Characters of a context that are looked at first; words that reach beyond them are taken whole in a second look.
NEAR = 200
#: What a pattern must score, and how many seeds of the kind it must hold.
CONFIDENT = 0.6
SEEDS = 3
#: Added to a pattern's number of instances, so that rare patterns score low.
SMOOTH = 1.0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda a, d: F.struct(
            (a["sum"] + F.when(a["i"] % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0))).otherwise(F.coalesce(d.try_cast("int"), F.lit(0)) * 2 - F.when(F.coalesce(d.try_cast("int"), F.lit(0)) > 4, 9).otherwise(0))).alias("sum"),
            (a["i"] + F.when(d == "", 0).otherwise(1)).alias("i"),
        ),
    )
    return doubled["sum"] % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _as_seed(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["value"].alias("value"), _words(s["left"], s["right"]).alias("patterns"))


def with_base(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Adds a column of base spans (start, end, value, left, right) for each kind."""
    out = docs
    for kind in KINDS:
        out = with_matches(out, text, kind, PATTERNS[kind], context=True)
        out = out.withColumn(kind, F.filter(F.col(kind), _checked(kind)))
    return out


def _near(left: Column) -> Column:
    """The end of a left context, which holds its last two words whole."""
    end = F.right(left, F.lit(NEAR))
    whole = end.rlike(r"(?:\s\S+[^\S\n]+\S+[^\S\n]+|\n[^\S\n]*\S+[^\S\n]+|\n[^\S\n]*|\S)$")
    far = F.reverse(F.regexp_extract(F.reverse(left), r"^([^\S\n]++\S++(?:[^\S\n]++\S++)?)", 1))
    return F.when((F.length(left) <= NEAR) | whole, end).otherwise(far)


def _words(left: Column, right: Column) -> Column:
    """The patterns that a context gives."""
    left, start = _near(left), F.left(right, F.lit(NEAR))
    right = F.when((F.length(right) <= NEAR) | start.rlike(r"^(?:[^\S\n]++\S++\s|\S|[^\S\n]*+\n)"), start).otherwise(right)
    before = F.lower(F.regexp_extract(left, r"(\S+)[^\S\n]+$", 1))
    two = F.lower(F.regexp_extract(left, r"(\S+[^\S\n]+\S+)[^\S\n]+$", 1))
    after = F.lower(F.regexp_extract(right, r"^[^\S\n]++(\S++)", 1))
    return F.array_compact(F.array(F.when(two != "", F.concat(two, F.lit(" _"))), F.when((before != "") & (after != ""), F.concat(before, F.lit(" _ "), after))))


def _shape(kind: Column, value: Column) -> Column:
    """Whether an unseen token could be of the kind."""
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", value.rlike("^[^@]+@[^@]+$"))
        .when(kind == "ip", value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
        .when(kind == "card", value.rlike(r"^[0-9\x20-]+$") & n.between(13, 19))
        .when(kind == "phone", value.rlike(r"^[+(]?[0-9][0-9().\x20-]+$") & n.between(7, 15))
    )


def _trimmed(lead: str):
    """A candidate without what ``lead`` matches at its start and without the marks at its end."""

    def cut(t: Column) -> Column:
        n = F.length(F.regexp_extract(t["value"], f"^({lead})", 1))
        value = F.regexp_replace(F.substring(t["value"], n + 1, F.length(t["value"])), "[^A-Za-z0-9]+$", "")
        return F.struct((t["start"] + n).alias("start"), value.alias("value"), t["left"].alias("left"), t["right"].alias("right"))

    return cut


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per input row: the columns ``keep``, key, base spans, and instances: the seeds and the tokens that no base span covers."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = with_matches(with_base(rows), "__text", "__token", TOKEN, context=True)
    rows = with_matches(rows, "__text", "__joined", JOINED, context=True)
    spans = F.concat(*(of_kind(k, F.col(k)) for k in KINDS))
    apart = F.filter("__joined", lambda t: ~t["right"].rlike("^[^\\s,;:!?]"))
    rows = rows.withColumn("__base", spans).withColumn("__token", F.concat(F.transform("__token", _trimmed(LABEL + "[^A-Za-z0-9@+]*")), F.transform(apart, _trimmed(LABEL))))
    free = F.filter("__token", lambda t: (F.length(t["value"]) >= 5) & ~F.exists("__base", lambda b: (b["start"] < t["start"] + F.length(t["value"])) & (t["start"] < b["end"])))
    rows = rows.withColumn("__free", free)
    seeds = F.concat(*(F.transform(F.col(k), _as_seed(k)) for k in KINDS))
    unseen = F.transform("__free", lambda t: F.struct(F.lit(None).cast("string").alias("kind"), t["start"].alias("start"), t["value"].alias("value"), _words(t["left"], t["right"]).alias("patterns")))
    return rows.select(*keep, *text_key(F.col("__text")), F.col("__base").alias("base"), F.concat(seeds, unseen).alias("instances"))


def bootstrap(scanned: DataFrame) -> DataFrame:
    """``value``, ``kind`` of the unseen instances that the rounds accept."""
    held = scanned.select(F.explode("instances").alias("i")).select("i.kind", "i.value", F.explode("i.patterns").alias("pattern"))
    links = materialize(held.groupBy("pattern", "value", "kind").count(), "links")
    # A seed believes in its own kind wholly; an unseen instance believes what its best pattern says.
    belief = links.where("kind is not null").select("value", "kind", F.lit(1.0).alias("belief")).distinct()
    found = None
    for _ in range(ROUNDS):
        known = links.select("pattern", "value").distinct().join(belief, "value", "left")
        scores = known.groupBy("pattern").agg(F.count_distinct("value").alias("n"), *(F.sum(F.when(F.col("kind") == k, F.col("belief")).otherwise(0.0)).alias(k) for k in KINDS))
        # A pattern leans to one kind: that of the largest sum, by the order of KINDS among equals.
        best = F.greatest(*KINDS)
        kind = F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in KINDS))
        scores = scores.select("pattern", kind.alias("kind"), (best / (F.col("n") + SMOOTH)).alias("score"), best.alias("support"))
        strong = materialize(scores.where((F.col("score") >= CONFIDENT) & (F.col("support") >= SEEDS)), "patterns")
        unseen = links.where("kind is null").select("pattern", "value").join(strong, "pattern").where(_shape(F.col("kind"), F.col("value")))
        found = unseen.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("top")).select("value", "top.kind", F.col("top.score").alias("belief"))
        found = materialize(found, "found")
        belief = links.where("kind is not null").select("value", "kind", F.lit(1.0).alias("belief")).distinct().unionByName(found)
    return found.select("value", F.col("kind").alias("added"))


def added_spans(scanned: DataFrame) -> DataFrame:
    """The spans that the method adds, once per text: the key and ``added``."""
    found = bootstrap(scanned)
    unseen = scanned.select(*KEY, F.explode("instances").alias("i")).where("i.kind is null").select(*KEY, "i.start", "i.value").distinct()
    spans = unseen.join(found, "value").select(*KEY, F.struct(F.col("added").alias("kind"), "start", (F.col("start") + F.length("value")).alias("end")).alias("s"))
    return materialize(spans.groupBy(*KEY).agg(F.collect_set("s").alias("added")), "added")


def with_spans(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, key, ``base`` and ``spans``. Only rows whose text may have added spans meet them in a join; nothing else is shuffled."""
    scanned = materialize(scan(docs, text, keep), "scanned")
    added = added_spans(scanned)
    rows = likely(scanned.drop("instances"), "k1", added.select("k1"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    alone = rows.where("not likely").withColumn("added", none)
    met = rows.where("likely").join(added, KEY, "left").withColumn("added", F.coalesce("added", none))
    spans = F.concat(*(F.array_sort(F.concat(F.filter("base", _is(k)), F.filter("added", _is(k)))) for k in KINDS))
    return alone.unionByName(met).withColumn("spans", spans).select(*keep, *KEY, "base", "spans")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, key, ``base`` and ``spans``: arrays of (kind, start, end) by kind, then start.

    A null text is an empty one; rows of equal text have equal spans; repeated rows and null ids are kept; an empty table
    gives an empty one; columns besides doc_id and text are ignored.
    """
    return with_spans(docs.select("doc_id", "text"), "text", ["doc_id"])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``find`` gives."""
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets and n_chars counted anew.

    Of overlapping spans the one that starts first stands (of equal starts the longer); what it covers goes whole, and a later
    span covers the rest of its own length. A null text stays null.
    """
    rows = with_spans(docs.select(F.struct(*docs.columns).alias("__own")), "__own.text", ["__own"])
    order = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    rows = rows.select(F.col("__own").alias("__doc"), F.col("__own.text").alias("text"), order.alias("spans"))
    none = F.array().cast("array<string>")
    done = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), none.alias("parts")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["end"] <= a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("parts"),
        ),
    )
    rows = rows.withColumn("__done", done)
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.array_join("__done.parts", ""), F.substring(F.col("text"), F.col("__done.at") + 1, F.length("text"))))
    new = {"text": clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") == 0, F.col("__doc.n_chars")).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*((new[c] if c in new else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns))
