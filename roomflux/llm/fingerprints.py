"""Document fingerprints: 128-bit SimHash with weighted terms, and near fingerprints by permuted block tables.

A term is a word with the word after it (lower-cased; a lone word is its own term). Each occurrence votes on 128 signed bits,
those of two 64-bit hashes of the term, with the term's length as weight. Votes are summed without leaving code generation:
a hash shifted by k and masked shows bits k and k + 32 as two 32-bit lanes of one long, so 32 sums hold 64 bits.

For the search the bits are cut into radius + 2 blocks; fingerprints within the radius agree on two blocks at least. For each
pair of blocks there is a table whose key they are. A link is counted in the first table in which it is met, within the
join, so pairs of fingerprints are never gathered; equal fingerprints are one entry.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomflux.plans.lineage import materialize

LANES = 0x0000000100000001
HALVES = 2
RADIUS = 3
WORD = r"[\x20\x09-\x0D]+"
#: Rows that one window orders when documents are put in sequence.
BLOCK_ROWS = 1024
MOST_BLOCKS = 1 << 16


def _terms(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` once per term of ``text``, as columns ``t1``, ``t2``; a text without words gives one row of null terms."""
    words = F.filter(F.split(F.lower(text), WORD), lambda w: w != "")
    out = rows.withColumn("__w", words)
    after = F.when(F.size("__w") > 1, F.slice("__w", F.lit(2), F.size("__w") - 1)).otherwise(F.array(F.lit("")))
    first = F.when(F.size("__w") > 1, F.slice("__w", F.lit(1), F.size("__w") - 1)).otherwise(F.col("__w"))
    out = out.withColumn("__z", F.arrays_zip(first.alias("t1"), after.alias("t2")))
    return out.select(*rows.columns, F.inline_outer("__z"))


def votes(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """``by`` and ``h0``, ``h1``: the two halves of the fingerprint of the text of each group of ``by``."""
    terms = _terms(rows.select(*by, text), F.col(text)).drop(text).toDF(*by, "t1", "t2")
    weight = F.coalesce(F.length("t1") + F.length("t2"), F.lit(0)).cast("long")
    hashed = terms.select(*by, weight.alias("w"), F.xxhash64("t1", "t2").alias("x0"), F.xxhash64("t2", "t1", F.lit(1)).alias("x1"))
    sums = [F.sum(F.shiftrightunsigned(f"x{h}", k).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"s{h}_{k}") for h in range(HALVES) for k in range(32)]
    out = hashed.groupBy(*by).agg(F.sum("w").alias("all"), *sums)

    def half(h: int) -> Column:
        bits = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"s{h}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{h}_{k}", 32)
            bits = bits.bitwiseOR(F.when(2 * low > F.col("all"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
            top = 1 << (k + 32)
            bits = bits.bitwiseOR(F.when(2 * high > F.col("all"), F.lit(top if top < 2**63 else top - 2**64)).otherwise(F.lit(0)).cast("long"))
        return bits

    return out.select(*by, half(0).alias("h0"), half(1).alias("h1"))


def as_hex(h0: str, h1: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.col(h0)), 16, "0"), F.lpad(F.hex(F.col(h1)), 16, "0")))


def likeness(a0, a1, b0, b1) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(F.col(a0).bitwiseXOR(F.col(b0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(b1)))) / (64.0 * HALVES)


def _bits(lo: int, hi: int) -> Column:
    """Bits lo to hi - 1 of the two halves, as a long (of under 63 bits in all)."""
    out, at = F.lit(0).cast("long"), 0
    for h in range(HALVES):
        a, b = max(lo, 64 * h), min(hi, 64 * h + 64)
        if a < b:
            part = F.shiftrightunsigned(f"h{h}", a - 64 * h).bitwiseAND(F.lit((1 << (b - a)) - 1))
            out, at = out.bitwiseOR(F.shiftleft(part, at)), at + b - a
    return out


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``h0``, ``h1``, ``n_near``: how many other fingerprints are within ``radius`` bits, for those that have one."""
    blocks = radius + 2
    cut = [round(k * 64 * HALVES / blocks) for k in range(blocks + 1)]
    own = [_bits(a, b) for a, b in zip(cut, cut[1:], strict=False)]
    rows = prints.select("h0", "h1").distinct().select("h0", "h1", *(c.alias(f"b{k}") for k, c in enumerate(own)))
    pairs = list(combinations(range(blocks), 2))
    keyed = rows.select("*", F.inline(F.array(*(F.struct(F.lit(n).alias("t"), F.col(f"b{i}").alias("x"), F.col(f"b{j}").alias("y")) for n, (i, j) in enumerate(pairs)))))
    keyed = materialize(keyed, "blocks")
    left, right = keyed.alias("l"), keyed.alias("r")
    apart = F.bit_count(F.col("l.h0").bitwiseXOR(F.col("r.h0"))) + F.bit_count(F.col("l.h1").bitwiseXOR(F.col("r.h1")))
    # The first table in which both blocks agree: no earlier pair of blocks does.
    earlier = F.lit(False)
    for n, (i, j) in enumerate(pairs):
        earlier |= (F.lit(n) < F.col("l.t")) & (F.col(f"l.b{i}") == F.col(f"r.b{i}")) & (F.col(f"l.b{j}") == F.col(f"r.b{j}"))
    on = (F.col("l.t") == F.col("r.t")) & (F.col("l.x") == F.col("r.x")) & (F.col("l.y") == F.col("r.y")) & apart.between(1, radius) & ~earlier
    return left.join(right, on).groupBy("l.h0", "l.h1").agg(F.count(F.lit(1)).alias("n_near"))


def _quantiles(rows: DataFrame, of: str, many: int) -> list:
    """The ``many`` - 1 values that cut ``of`` into ``many`` parts, in order, repeated where one value fills several parts."""
    if many < 2:
        return []
    shares = F.split(F.lit(",".join(str(k / many) for k in range(1, many))), ",").cast("array<double>")
    return rows.agg(F.percentile_approx(of, shares, max(10_000, 8 * many))).first()[0] or []


def _at(values: list, kind: str, k: Column) -> Column:
    """The ``k``-th of ``values``, held in the plan as one literal."""
    return F.try_element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), k)


def _reached(cuts: list, kind: str, value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, by bisection."""

    def further(at: Column, k: Column) -> Column:
        ahead = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((ahead <= len(cuts)) & (_at(cuts, kind, ahead) <= value), ahead).otherwise(at)

    return F.aggregate(F.sequence(F.lit(len(cuts).bit_length()), F.lit(0), F.lit(-1)), F.lit(0), further) if cuts else F.lit(0)


def in_sequence(docs: DataFrame) -> DataFrame:
    """``rid``, ``block``, ``doc_id``, ``text`` and ``follower``: rows in order of (doc_id, text), each with the next one's text.

    Rows are dealt to blocks of about ``BLOCK_ROWS`` by quantiles of doc_id, and each block is ordered by itself; its last row
    has a null follower. Null ids come last. An id that fills blocks of its own, and the null ids, are cut further by quantiles
    of the first bytes of their texts; only rows with the id and those bytes in common stay in one block whatever their number.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, known = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    found = _quantiles(rows, "doc_id", min(MOST_BLOCKS, max(1, n // BLOCK_ROWS)))
    cuts, hot = sorted(set(found)), sorted(v for v, times in Counter(found).items() if times > 1)
    rows = rows.withColumn("base", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(_reached(cuts, "bigint", F.col("doc_id"))))
    if hot or n - known > BLOCK_ROWS:
        nth = _reached(hot, "bigint", F.col("doc_id"))
        place = F.when(F.col("doc_id").isNull(), len(hot)).when(_at(hot, "bigint", F.nullif(nth, F.lit(0))) == F.col("doc_id") if hot else F.lit(False), nth - 1)
        start = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double") / (1 << 48)
        rows = rows.withColumn("finer", place + start)
        held = rows.where("finer IS NOT NULL")
        parts = _quantiles(held, "finer", min(MOST_BLOCKS, held.count() // BLOCK_ROWS))
        parts = sorted(set(parts))
        # Other ids of the same base are greater than the hot one, with which it begins.
        sub = F.when(F.col("finer").isNull(), len(parts) + 1).otherwise(_reached(parts, "double", F.col("finer")))
    else:
        sub = F.lit(0)
    rows = rows.select("doc_id", "text", (F.col("base").cast("long") * (1 << 17) + sub).alias("block"))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("follower", F.lead("text").over(order))
    return rows.withColumn("rid", F.col("block") * (1 << 29) + F.col("nth"))


def edited(text: Column, follower: Column) -> Column:
    """``text`` with its last half replaced by as many characters from the start of ``follower``, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(follower, half))


def fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of each row.

    A null text is an empty one; a text without words has fingerprint zero; equal texts have equal fingerprints; repeated
    rows follow each other, of one doc_id in order of text; null ids come last; a table of one row follows itself; an empty
    table gives an empty one; columns besides doc_id and text are ignored.
    """
    rows = in_sequence(docs)
    # One row per block: the first one, which follows the last one of the block before. Only numbers are ordered as a whole.
    firsts = materialize(rows.where("nth = 1").select("block", "rid", "text"), "firsts")
    around = Window.orderBy("block")
    after = firsts.select("block", *(F.coalesce(F.lead(c).over(around), F.first(c).over(around)).alias(f"next_{c}") for c in ("block", "rid")))
    ring = after.join(firsts.select(F.col("block").alias("next_block"), F.col("text").alias("after_text")), "next_block").select(F.col("block").alias("last_of"), F.col("next_rid").alias("after_rid"), "after_text")
    full = rows.join(ring, (F.col("block") == F.col("last_of")) & F.col("follower").isNull(), "left")
    full = full.withColumn("next_rid", F.coalesce("after_rid", F.col("rid") + 1)).withColumn("follower", F.coalesce("follower", "after_text"))
    full = full.select("block", "rid", "next_rid", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited(F.col("text"), F.col("follower")).alias("edited"))
    full = full.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    # Rows already lie by block, so groups that name it need no further exchange.
    by = ["block", "rid", "next_rid", "doc_id", "n_chars", "edited_sha256", "which"]
    two = full.select(*by[:-1], F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))))
    prints = materialize(votes(two, "body", by).drop("block"), "prints")
    text = prints.where("which = 0").drop("which")
    of_edited = prints.where("which = 1").select("rid", F.col("h0").alias("e0"), F.col("h1").alias("e1"))
    of_next = prints.where("which = 0").select(F.col("rid").alias("next_rid"), F.col("h0").alias("n0"), F.col("h1").alias("n1"))
    links = materialize(near_links(text, radius), "near")
    out = text.join(of_edited, "rid").join(of_next, "next_rid").join(links, ["h0", "h1"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex("h0", "h1").alias("fingerprint"), as_hex("e0", "e1").alias("edited_fingerprint"), likeness("h0", "h1", "e0", "e1").alias("near_edited"), likeness("h0", "h1", "n0", "n1").alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
