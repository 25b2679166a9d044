"""Mixing sources to target weights: a splitting tree over blocks of documents.

A source's documents fall into ``FAN`` blocks by a seeded hash. Its target in words is a number of whole passes over all its
blocks plus, in the last pass, blocks in a permuted order until the rest is reached; the block where the rest ends is cut the
same way into ``FAN`` smaller ones, ``LEVELS`` times, and in the last of these documents are taken in hash order, the final
one in part. So no task ever orders more than ``FAN`` cells, or the few documents of one smallest cell, of a source.

Drawn blocks are dealt to the output shards by a tree: at each node the quotas of blocks by source are split between two
halves of the shards by a multivariate hypergeometric draw, made exactly, by dealing one token per block in random order.
A shard then takes its quota of each source from that source's permuted draws, from where the shard before it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflux.plans.lineage import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
FAN = 256
LEVELS = 3
SEED = 7
#: Levels of the tree: 2 ** DEPTH shards.
DEPTH = 3
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), "")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Adds __size, __u (the row's hash) to ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__size", n_words(F.col("text"))).withColumn("__u", F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), text))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sid, source, source_size, target: shares of all words by weight, none above ``most`` times its source's size.

    The level L for which the sum of min(most * size, L * weight) is the total is read off prefix sums over the sources in
    order of most * size / weight. There is one row per source.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    every = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
    rows = rows.withColumn("capped", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # From the first source on whose own cap is not reached, the level stays.
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("sid"), F.col("level").alias("level")))).over(every)["level"]
    rows = rows.withColumn("target", F.least(F.col("most"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return rows.select("sid", "source", "source_size", "target")


def _cells(rows: DataFrame, by: list[str], quota: DataFrame, digit: str) -> DataFrame:
    """Cells ``by`` + ``digit`` of the rows under an open quota: cell_size and take, in a permuted order within ``by``."""
    sums = rows.join(quota, by).groupBy(*by, digit, "quota").agg(F.sum("size").alias("cell_size"))
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(SEED + 1), *by, digit), digit).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cell_size").over(order), F.lit(0))
    return sums.select(*by, digit, "cell_size", F.greatest(F.lit(0), F.least(F.col("cell_size"), F.col("quota") - before)).alias("take"))


def deal(draws: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``draws`` (sid, pass, d1) with ``shard``, by the splitting tree. One row per drawn block: a few hundred per source."""
    ranked = draws.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(SEED + 2), "sid", "pass", "d1"), "pass", "d1")))
    tokens = ranked.select("sid", "rank", F.lit(0).alias("node"))
    for level in range(depth):
        mixed = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(SEED + 3 + level), "sid", "rank"), "sid", "rank")
        place = F.row_number().over(mixed)
        tokens = tokens.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("node"))).withColumn("__p", place)
        tokens = tokens.select("sid", "rank", (F.col("node") * 2 + F.when(2 * F.col("__p") > F.col("__n"), 1).otherwise(0)).alias("node"))
    quotas = tokens.groupBy("sid", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("blocks"))
    upto = quotas.withColumn("upto", F.sum("blocks").over(Window.partitionBy("sid").orderBy("shard")))
    slots = upto.select("sid", "shard", F.explode(F.sequence(F.col("upto") - F.col("blocks") + 1, F.col("upto"))).alias("rank"))
    return ranked.join(slots, ["sid", "rank"]).select("sid", "pass", "d1", "shard")


def decide(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, depth: int = DEPTH, keep: bool = True) -> DataFrame:
    """``sizes`` (source, size, u and others) with source_size, target, passes, rest, taken and ``shards``. ``sizes`` is read several times.

    ``passes``: how often the whole document is taken; ``rest``: words taken from its start besides; ``shards``: where each
    pass puts it, in order of passes.
    """
    plan = materialize(targets(sizes, weights, most), "targets")
    plan = plan.withColumn("words", F.round("target").cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("quota", F.col("words") - F.col("passes") * F.col("source_size"))
    digits = [F.shiftrightunsigned("u", 8 * k).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(f"d{k + 1}") for k in range(LEVELS)]
    rows = sizes.select("*", *digits).join(plan.select("sid", F.col("source").alias("__source"), "source_size", "target", "passes"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    if keep:
        rows = materialize(rows, "sized")
    by, quota, levels = ["sid"], plan.select("sid", "quota"), []
    for k in range(LEVELS):
        cells = materialize(_cells(rows, by, quota, f"d{k + 1}"), "cells")
        by = [*by, f"d{k + 1}"]
        levels.append((list(by), cells))
        quota = cells.where("take > 0 and take < cell_size").select(*by, F.col("take").alias("quota"))
    blocks = levels[0][1]
    passes = plan.select("sid", "passes")
    draws = blocks.join(passes, "sid").select("sid", "d1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"), "passes", "take", "cell_size")
    draws = draws.where((F.col("cell_size") > 0) & ((F.col("pass") < F.col("passes")) | (F.col("take") > 0))).select("sid", "pass", "d1")
    placed = deal(draws, depth).groupBy("sid", "d1").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("places"))
    out = rows.join(materialize(placed, "places"), ["sid", "d1"], "left")
    state = F.lit(None).cast("double")
    for k, (on, cells) in enumerate(levels):
        out = out.join(cells.select(*on, F.when(F.col("take") >= F.col("cell_size"), 1.0).when(F.col("take") <= 0, 0.0).otherwise(0.5).alias(f"s{k}"), F.col("take").alias(f"q{k}")), on, "left")
        state = F.when(state.isNull() | (state == 0.5), F.col(f"s{k}")).otherwise(state)
    out = out.withColumn("__state", F.coalesce(state, F.lit(0.0)))
    # The last cells: one per source, of about a 2 ** 24th of its documents.
    cell = out.where("__state = 0.5")
    order = Window.partitionBy(*by).orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col(f"q{LEVELS - 1}") - F.coalesce(F.sum("size").over(order), F.lit(0)))).cast("long")
    cell = cell.withColumn("rest", rest)
    other = out.where("__state <> 0.5").withColumn("rest", F.when(F.col("__state") == 1.0, F.col("size")).otherwise(0).cast("long"))
    done = other.unionByName(cell)
    shards = F.transform(F.filter(F.coalesce("places", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda p: (p["pass"] < F.col("passes")) | (F.col("rest") > 0)), lambda p: p["shard"])
    return done.select(*sizes.columns, "source_size", "target", "passes", "rest", (F.col("passes") * F.col("size") + F.col("rest")).alias("taken"), shards.alias("shards"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of each row.

    A null text is of size 0; null sources are one source, the last; repeated rows count as often as they come and one of them
    may be taken where another is not; null ids are kept; an empty table gives an empty one; further columns are ignored.
    """
    rows = sized(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")))
    sizes = materialize(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("__size").alias("size"), F.col("__u").alias("u")), "sizes")
    return decide(sizes).select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix itself, columns as in ``docs``: a row once per pass, and the words of its rest, laid out by shard.

    Within a shard rows are in hash order. A row of which only a rest is taken has that many words of its text, from the start,
    and its n_chars counted anew. Documents without words stand once. Null sources are one source; a null text stays null; an
    empty table gives an empty one; other columns may have any names. Texts lie beside the decisions throughout, which come
    from tables of a few rows per source; they are shuffled once, into the shards.
    """
    own = sized(docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text", F.col("source").cast("string").alias("source")))
    own = materialize(own.select("__doc", "source", F.col("__size").alias("size"), F.col("__u").alias("u")), "rows")
    rows = decide(own, keep=False).where((F.col("taken") > 0) | (F.col("size") == 0))
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("passes") + F.when(F.col("rest") == F.col("size"), 1).otherwise(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when((F.col("rest") > 0) & (F.col("rest") < F.col("size")), F.array("rest")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("*", F.posexplode(copies).alias("__pass", "__words"))
    text = F.col("__doc.text")
    words = F.array_remove(F.split(text, SPACE), "")
    new = {"text": F.when(F.col("__words") < 0, text).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.col("__words").cast("int"))), " "))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__words") < 0, F.col("__doc.n_chars")).otherwise(F.length(new["text"])).cast(docs.schema["n_chars"].dataType)
    shard = F.coalesce(F.get("shards", F.col("__pass")), F.lit(0))
    made = [(new[c] if c in new else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns]
    rows = rows.select(F.struct(*made).alias("__doc"), shard.alias("__shard"), F.xxhash64(F.lit(SEED + 9), "u", "__pass").alias("__place"))
    rows = rows.repartitionByRange("__shard", "__place").sortWithinPartitions("__shard", "__place")
    return rows.select("__doc.*")
