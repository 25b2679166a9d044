"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint is a path in a binary trie. The self-join walks pairs of nodes of equal depth together, adds one to the
error of a pair when the two take different branches, and drops a pair as soon as its error exceeds the budget.

To run on many executors a trie is cut into subtrees. ``tables`` permuted bit orders are used; in each, a run of bits
comes first, and two fingerprints within the budget agree on at least one such run (pigeonhole), so a subtree below one
value of the run can be joined alone. A subtree with more than ``hot`` fingerprints is cut again into pairs of its
sub-nodes whose own difference is within the budget, so that no task holds an unbounded group. Within a task the walk is
level by level over sorted arrays in bounded chunks. A task returns a star forest of what it has linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflux.llm.batches import bounded, slices
from roomflux.llm.spans import likely
from roomflux.plans.components import connected_components
from roomflux.plans.lineage import forget, materialize, release

SEED = 42
#: Odd multipliers of a 64-bit finaliser; a further fingerprint word is the mix of a shingle's hash with one of these.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
CHUNK = 1 << 18


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (repeats included; fewer words: of the whole sequence; none: empty)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    grams = zip(*(parts[k:] for k in range(words)), strict=False) if len(parts) >= words else [parts]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64, max(1, len(parts) - words + 1))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """``n_words`` 64-bit words; a bit is 1 if set in over half of the hashes."""
    out = np.zeros(n_words, np.uint64)
    if not len(hashes):
        return out
    for k in range(n_words):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            h = _mixed(hashes[at : at + (1 << 16)], k)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[k] = np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = 3, n_words: int = 1) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fingerprint`` (lowercase hex, 16 digits a word) of each row's whole ``text``; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = ["".join(f"{x:016x}" for x in fingerprint(shingle_hashes(t.as_py(), words), n_words).tolist()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(made, pa.string())], names=["doc_id", "text_hash", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(rows).select("doc_id", _text_hash().alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fingerprint string")


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of each a and b; afterwards parent holds each item's least member."""
    while len(a):
        x, y = parent[a], parent[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def trie_links(keys: np.ndarray, prints: np.ndarray, near: int, far: int, split: int | None = None, chunk: int = CHUNK) -> np.ndarray:
    """Least linked item of each item, by the walk over node pairs.

    ``keys`` (uint64, sorted): the bits that the trie is built over, most significant first; ``near`` is the budget on them.
    ``prints`` (n x words): whole fingerprints; a leaf pair is linked within ``far`` differing bits. ``split``: walk only pairs
    of an item before and an item from this position on.
    """
    n = len(keys)
    parent = np.arange(n)
    first = [0, n, 0, n, 0] if split is None else [0, split, split, n, 0]
    stack = [(63, *(np.array([x], np.int64) for x in first))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > chunk:
            half = len(al) // 2
            stack += [(bit, *(x[:half] for x in (al, ah, bl, bh, err))), (bit, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        small = (ah - al) * (bh - bl) <= 64
        if bit < 0:
            small[:] = False
            if len(al):  # equal keys throughout: every pair goes to the leaf test, one row of the left node at a time
                wide = np.repeat(np.arange(len(al)), ah - al)
                left = np.arange(len(wide)) - np.repeat(np.cumsum(ah - al) - (ah - al), ah - al) + al[wide]
                for at in range(0, len(left), max(1, chunk // max(1, int((bh - bl).max())))):
                    s = slice(at, at + max(1, chunk // max(1, int((bh - bl).max()))))
                    _leaf(parent, keys, prints, left[s], left[s] + 1, bl[wide[s]], bh[wide[s]], near, far)
            continue
        if small.any():
            _leaf(parent, keys, prints, al[small], ah[small], bl[small], bh[small], near, far)
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        one = np.uint64(1) << np.uint64(bit)
        clear = ~np.uint64((1 << (bit + 1)) - 1) if bit < 63 else np.uint64(0)
        am = np.clip(np.searchsorted(keys, (keys[al] & clear) | one), al, ah)
        bm = np.clip(np.searchsorted(keys, (keys[bl] & clear) | one), bl, bh)
        own = (al == bl) & (ah == bh)
        steps = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        last = ~own
        steps.append(tuple(x[last] for x in (am, ah, bl, bm, err + 1)))
        made = [np.concatenate([s[k] for s in steps]) for k in range(5)]
        keep = (made[0] < made[1]) & (made[2] < made[3]) & (made[4] <= near)
        stack.append((bit - 1, *(x[keep] for x in made)))
    return parent


def _leaf(parent, keys, prints, al, ah, bl, bh, near, far) -> None:
    wide = (ah - al) * (bh - bl)
    row = np.repeat(np.arange(len(wide)), wide)
    k = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
    width = (bh - bl)[row]
    a, b = al[row] + k // width, bl[row] + k % width
    ok = a != b
    a, b = a[ok], b[ok]
    ok = np.bitwise_count(keys[a] ^ keys[b]) <= near
    a, b = a[ok], b[ok]
    ok = np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= far
    _roots(parent, a[ok], b[ok])


def plan_tables(bits: int, radius: int) -> list[tuple[list[int], list[int], int]]:
    """Runs (leading bits, further bits, budget on both) for an exact join: one of radius + 1 runs is free of errors."""
    cut = [round(k * bits / (radius + 1)) for k in range(radius + 2)]
    return [(list(range(a, b)), [x for x in range(bits) if not a <= x < b], radius) for a, b in zip(cut, cut[1:], strict=False)]


def _picked(words: list, bits: list[int]):
    """The named bits as one long, the first the most significant of 64; bit 0 is the top bit of the first word."""
    out = F.lit(0).cast("long")
    at, k = 0, 0
    while k < len(bits):  # one shift for each run of neighbours
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] + n and (bits[k] + n) % 64 and at + n < 64:
            n += 1
        word, low = words[bits[k] // 64], 63 - (bits[k] + n - 1) % 64
        part = F.shiftrightunsigned(word, low)
        part = part if n == 64 else part.bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, 64 - at - n))
        at, k = at + n, k + n
    return out


def _long(hex16):
    """16 hex digits as the long of the same bits."""
    return F.shiftleft(F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(hex16, 9, 8), 16, 10).cast("long"))


def linked_classes(prints: DataFrame, tables: list, far: int, n_words: int = 1, hot: int = 50_000) -> DataFrame:
    """``fingerprint``, ``label`` (least fingerprint that links reach) of the distinct fingerprints that have a link."""
    words = [F.col(f"w{k}") for k in range(n_words)]
    base = materialize(prints.select("fingerprint").distinct().select("fingerprint", *(_long(F.substring("fingerprint", 16 * k + 1, 16)).alias(f"w{k}") for k in range(n_words))), "prints")
    near = tables[0][2]
    rows = base.select("*", F.inline(F.array(*(F.struct(F.lit(i).alias("t"), _picked(words, lead).alias("run"), _picked(words, rest[:64]).alias("key")) for i, (lead, rest, _) in enumerate(tables)))))
    counts = materialize(rows.groupBy("t", "run").count().where(F.col("count") > hot).select("t", "run", F.lit(True).alias("hot")), "hot")
    flips = [m for m in range(256) if bin(m).count("1") <= near]
    top = F.shiftrightunsigned("key", 56)
    if counts.limit(1).count():
        rows = rows.join(counts, ["t", "run"], "left")
    else:
        rows = rows.withColumn("hot", F.lit(None).cast("boolean"))
    rows = rows.withColumn("flip", F.explode(F.when(F.col("hot"), F.array(*map(F.lit, flips))).otherwise(F.array(F.lit(-1)))))
    rows = rows.withColumn("node", F.when(F.col("hot"), F.least(top, top.bitwiseXOR(F.col("flip").cast("long")))).otherwise(F.lit(-1).cast("long")))

    ids, columns = ["t", "run", "node", "flip"], ["key", *(f"w{k}" for k in range(n_words))]

    def join(flip: int, parts: list[np.ndarray]) -> tuple[list[str], list[str]]:
        """The links of one subtree; ``parts``: rows of key and words."""
        rows = np.concatenate(parts).view(np.uint64)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        keys, bits = np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1:])
        split = int(np.searchsorted(keys >> np.uint64(56), (keys[0] >> np.uint64(56)) + np.uint64(1))) if flip > 0 else None
        parent = trie_links(keys, bits, near, far, split) if split is None or split < len(keys) else np.arange(len(keys))
        told = np.flatnonzero(parent != np.arange(len(keys)))
        return tuple(["".join(f"{x:016x}" for x in row) for row in bits[at].tolist()] for at in (told, parent[told]))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by subtree; at most one subtree is held besides the batch read."""
        held: list[np.ndarray] = []
        last, found = None, ([], [])

        def done() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found], names=["a", "b"])
            for x in found:
                x.clear()
            return made

        def close() -> None:
            if sum(map(len, held)) > 1:
                for x, y in zip(found, join(int(last[3]), held), strict=True):
                    x.extend(y)
            held.clear()

        for b in batches:
            names = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ids], 1)
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if last is None or (names[lo] != last).any():
                        close()
                        last = names[lo].copy()
                    held.append(rows[lo:hi].copy())
            yield done()
        close()
        yield done()

    edges = rows.select(*ids, *columns).repartition(*ids).sortWithinPartitions(*ids).mapInArrow(runs, "a string, b string")
    return connected_components(edges).withColumnRenamed("node", "fingerprint")


def classes(prints: DataFrame, tables: list, far: int, n_words: int = 1, hot: int = 50_000) -> DataFrame:
    """Each row of ``doc_id``, ``fingerprint`` with ``component_id``, the smallest doc_id that links reach."""
    own = materialize(prints, "own")
    labels = linked_classes(own, tables, far, n_words, hot)
    least = own.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    labelled = materialize(least.join(labels, "fingerprint", "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")), "labelled")
    reach = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialize(labelled.join(reach, "label").select("fingerprint", "component_id"), "classes")
    return own.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Exact join of 64-bit fingerprints at ``radius`` or fewer differing bits: doc_id, fingerprint, component_id.

    Null and empty texts have fingerprint zero and are linked like any other; equal fingerprints are one class; a null
    doc_id keeps its row and is never a component_id unless the whole class is null; repeated rows come out as often as they
    came in; an empty table gives an empty one; columns besides doc_id and text are ignored.
    """
    return classes(fingerprints(docs, words).drop("text_hash"), plan_tables(64, radius), radius)


#: Longs of the parity sketch of a shingle set, at least; a shingle toggles one bit.
PARITY = 16
#: Turns in which other sets take the place of the least one of a shingle; the result does not depend on it.
TURNS = 2
#: One of so many sets, by a hash, is compared with all that share a prefix shingle; then the others, where classes still differ.
SHARES = (16, 1)
#: Least prefix shingles of a set that tell whether a pair is met at a lesser one too.
FIRSTS = 16
#: Texts whose whole sets one task makes.
WANTED = 500
#: Texts that the common shingles are counted in, and how many of them must hold a shingle.
COUNTED = 4_000
COMMON = 4


def parity(shingles: np.ndarray) -> np.ndarray:
    """Longs in which each shingle toggles a bit. Two sets' sketches differ in at most as many bits as the sets in members.

    There are ``PARITY`` longs, doubled until they have as many bits as the set has members, so that sketches of long sets tell
    them apart too. A sketch folds: the exclusive or of its halves is the sketch of half the length.
    """
    longs = PARITY
    while 64 * longs < len(shingles):
        longs *= 2
    odd = np.bincount((_mixed(shingles, 1) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(sketch, longs):
    """A sketch folded to ``longs`` if it has twice as many."""
    halves = F.zip_with(F.slice(sketch, F.lit(1), longs), F.slice(sketch, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > longs, halves).otherwise(sketch)


def sketch_distance(x, y):
    """In how many bits two sketches differ, the longer folded to the length of the other; of sketches that differ fourfold, 0."""
    longs = F.least(F.size(x), F.size(y))
    bits = F.aggregate(F.zip_with(_folded(x, longs), _folded(y, longs), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * longs, bits).otherwise(0)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many of a bounded sample of the distinct texts hold, and in how many. Only the order of shingles depends on it."""
    every = max(1, docs.count() // COUNTED)
    texts = docs.select(F.col("text").cast("string").alias("text"), _text_hash().alias("h")).where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["h"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            shingles, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    found = bounded(texts).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toArrow()
    shingles, n = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def shingle_sets(docs: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Of each row of ``docs``: row (doc_id and hash of the text), set (a hash of its shingle set), shingles (distinct, the rare first), n, prefix, fingerprint and sketch.

    Sets of Jaccard ``similarity`` share a shingle among the first ``prefix`` of each, whatever the order, if it is the same for all.
    """
    common, held_by = common or common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets, keys, prefix, prints, sketches = [], [], [], [], []
            for t in b.column("text"):
                own = np.unique(shingle_hashes(t.as_py(), words))
                prints.append(f"{int(fingerprint(own)[0]):016x}")
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                if len(common) and len(own):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.argsort(np.where(common[at] == own, held_by[at], 0), kind="stable")]
                sets.append(own.view(np.int64))
                prefix.append(len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0)
                sketches.append(parity(own))
            listed = [pa.array(x, pa.list_(pa.int64())) for x in (sets, sketches)]
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array(keys, pa.int64()), listed[0], pa.array(map(len, sets), pa.int32()), pa.array(prefix, pa.int32()), pa.array(prints, pa.string()), listed[1]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "set", "shingles", "n", "prefix", "fingerprint", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    made = bounded(rows).mapInArrow(run, "doc_id long, text_hash long, set long, shingles array<long>, n int, prefix int, fingerprint string, sketch array<long>")
    return made.select(F.struct("doc_id", "text_hash").alias("row"), "set", "shingles", "n", "prefix", "fingerprint", "sketch")


def _alike(pairs: DataFrame, whole, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: sets) whose Jaccard similarity is ``similarity`` or more; ``whole`` gives the shingles of named sets."""
    if pairs.isEmpty():
        return pairs.limit(0)
    named = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    held = materialize(whole(named), "held")
    both = pairs.join(held.toDF("a", "__a"), "a").join(held.toDF("b", "__b"), "b")
    shared = F.size(F.array_intersect("__a", "__b"))
    found = materialize(both.where(shared >= similarity * (F.size("__a") + F.size("__b") - shared) - 1e-9).select("a", "b"), "alike")
    release(held)
    forget(found.sparkSession)
    return found


def print_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Candidates (a, b) by the trie self-join of fingerprints: each set with the least of its class."""
    named = sets.select("set", "fingerprint").distinct()
    labels = linked_classes(named.select("fingerprint"), plan_tables(64, radius), radius)
    labelled = materialize(named.join(labels, "fingerprint", "left").select("set", F.coalesce("label", "fingerprint").alias("label")), "named")
    least = labelled.groupBy("label").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a <> z")
    return labelled.join(least, "label").where("a <> set").select("a", F.col("set").alias("b"))


def meetings(left: DataFrame, narrow: DataFrame, possible, share: int = 1) -> DataFrame:
    """Pairs (a < b) of sets of different label that share a shingle in ``left`` (set, shingle, label) and are ``possible``; of one in ``share`` sets with all.

    A pair is left out where the first shingles of both tell that it meets at a lesser one too: it is never lost, and comes once
    where it meets among these.
    """
    firsts = left.groupBy("set").agg(F.slice(F.sort_array(F.collect_list("shingle")), 1, FIRSTS).alias("firsts"))
    full = left.join(narrow, "set").join(firsts, "set").withColumn("chosen", F.pmod(F.xxhash64("set", F.lit("share")), F.lit(share)) == 0)
    x, y = full.alias("x"), full.where("chosen").alias("y")
    once = (F.col("x.set") < F.col("y.set")) | ~F.col("x.chosen")
    here = F.coalesce(F.array_min(F.array_intersect("x.firsts", "y.firsts")) >= F.col("x.shingle"), F.lit(True))
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & once & here & possible("x", "y"))
    return pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b"))


def alike_classes(sets: DataFrame, whole, similarity: float, radius: int = 3) -> DataFrame:
    """``set``, ``label`` (least set that links reach) of the sets that have a link; ``sets`` may repeat and holds the prefixes as ``shingles``.

    Exact: every pair of sets of Jaccard ``similarity`` is linked or in one class already, and no other pair is. The trie
    self-join of fingerprints and the least set of each prefix shingle propose the first candidates; they join large families
    by a number of tests in proportion to their size. Where classes still share a shingle, other sets of it take the place of
    the least for ``TURNS`` turns, which leaves few pairs of large families apart. Of the pairs that share a prefix
    shingle, those that then still differ in class are tested pair by pair: first those of a share of the sets, whose links
    join most of a large family, then the rest (``SHARES``). Shingles of the same sets count as one, and a pair is taken at the
    least shingle where it meets, not at each. Pairs are tested on whole sets unless lengths or sketches show that too many
    members differ. A step that finds no link leaves classes as they are, so they are not made again; where nothing is undone
    the steps end.
    """
    postings = sets.select("set", F.explode("shingles").alias("shingle"))
    hubs = postings.groupBy("shingle").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a <> z").select("shingle", "a")
    # Tables by shingle grow with the input, so none of them is broadcast, however small.
    shared = materialize(postings.join(hubs.hint("merge"), "shingle").distinct(), "shared")
    narrow = materialize(sets.drop("row", "shingles", "fingerprint").dropDuplicates(["set"]), "narrow")
    slack = (1 - similarity) / (1 + similarity)

    def possible(x: str, y: str):
        """Whether lengths and sketches leave room: similar sets differ in a share ``slack`` of their summed lengths at most."""
        room = slack * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-6
        return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= room) & (sketch_distance(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")) <= room)

    def tested(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are alike."""
        own = pairs.join(narrow.alias("x"), F.col("a") == F.col("x.set")).join(narrow.alias("y"), F.col("b") == F.col("y.set")).where(possible("x", "y")).select("a", "b")
        own = materialize(own, "pairs")
        found = _alike(own, whole, similarity)
        release(own)
        return found

    def undone(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """``set``, ``shingle``, ``label`` where sets of several classes share a prefix shingle, of shingles with the same sets the least alone; releases ``rows``."""
        left = materialize(rows.select("set", "shingle").join(classes, "set", "left").withColumn("label", F.coalesce("label", "set")), "left")
        release(rows)
        marks = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set")).alias("p"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("q")
        several = left.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *marks).where("lo <> hi")
        several = several.groupBy("lo", "hi", "n", "p", "q").agg(F.min("shingle").alias("shingle")).select("shingle")
        rest = materialize(left.join(several.hint("merge"), "shingle", "left_semi"), "undone")
        release(left)
        forget(rest.sparkSession)
        return rest

    def joined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links, ``found`` with them, and the classes (set, label) that they make."""
        every = materialize(linked.unionByName(found), "linked")
        return every, connected_components(every).toDF("set", "label")

    linked = tested(shared.where("a <> set").select("a", F.col("set").alias("b")).unionByName(print_pairs(sets, radius)).distinct())
    classes = connected_components(linked).toDF("set", "label")
    left = undone(shared, classes)
    for turn in range(1, TURNS + 1):
        if left.isEmpty():
            break
        # Another set of each shingle is its star now: the least by a hash that changes with the turn.
        hubs = left.groupBy("shingle").agg(F.min_by(F.struct("set", "label"), F.struct(F.xxhash64("set", F.lit(turn)), "set")).alias("hub"))
        pairs = left.join(hubs.hint("merge"), "shingle").where("label <> hub.label").select(F.least("set", "hub.set").alias("a"), F.greatest("set", "hub.set").alias("b")).distinct()
        found = tested(pairs)
        if not found.isEmpty():
            linked, classes = joined(found)
            left = undone(left, classes)
    for share in SHARES:
        if left.isEmpty():
            break
        rest = materialize(meetings(left, narrow, possible, share).distinct(), "rest")
        found = _alike(rest, whole, similarity)
        release(rest)
        if not found.isEmpty():
            linked, classes = joined(found)
            if share > 1:
                left = undone(left, classes)
    release(left)
    release(narrow)
    return classes


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """Groups by links of Jaccard ``similarity`` or more between sets of five-word shingles: row (doc_id and hash of the text), component_id (the least row).

    Every such pair is in one group and no other link is taken. Texts of fewer words are one shingle; texts without words make
    none and group with each other. Only prefixes and sketches of sets are written; the whole sets are made again from the
    texts that have candidates.
    """
    common = common_shingles(docs, words)
    made = materialize(shingle_sets(docs, words, similarity, common).withColumn("shingles", F.slice("shingles", F.lit(1), F.col("prefix"))).drop("prefix"), "sets")
    of = materialize(made.select("row", "set"), "rows")

    def whole(named: DataFrame) -> DataFrame:
        """``set``, ``shingles`` of the named sets, from one row of each."""
        one = materialize(of.join(named, "set", "left_semi").groupBy("set").agg(F.min("row").alias("row")).select("row.*").toDF("__id", "__hash"), "wanted")
        texts = likely(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("__text")), "__text", one.select("__hash")).where("likely")
        # So many parts that none holds more than about WANTED texts, which may all be long ones.
        texts = texts.join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi").dropDuplicates(["doc_id", "__text"]).repartition(one.count() // WANTED + 1, "__text")
        return shingle_sets(texts, words, similarity, common).select("set", "shingles").dropDuplicates(["set"])

    labels = materialize(alike_classes(made, whole, similarity, radius), "labels")
    release(made)
    least = of.groupBy("set").agg(F.min("row").alias("least"))
    labelled = materialize(least.join(labels, "set", "left").select("set", "least", F.coalesce("label", "set").alias("label")), "labelled")
    reach = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = materialize(labelled.join(reach, "label").select("set", "component_id"), "classes")
    return of.join(classes, "set").select("row", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays (by the hash of its text if texts share the id), one row if that repeats. Rows without a doc_id stay.

    Null and empty texts are one group; an empty table gives an empty one; other columns may have any names. Only rows that
    may have to go meet the decisions in a join; all others are written as they are read.
    """
    groups = near_duplicate_groups(docs.where("doc_id is not null"), **options)
    rows = groups.groupBy("row").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    concerned = rows.where("row <> component_id or n > 1").select("row.doc_id", "row.text_hash", (F.col("row") == F.col("component_id")).alias("stays"))
    concerned = materialize(concerned.toDF("__id", "__hash", "__stays"), "concerned")
    own = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").cast("long").alias("__own"), _text_hash().alias("__text"))
    own = likely(own, "__text", concerned.select("__hash"))
    met = own.where("likely and __own is not null").join(concerned, (F.col("__own") == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left")
    kept = met.where("__id is null or __stays").dropDuplicates(["__own", "__text"])
    return own.where("not likely or __own is null").select("__doc.*").unionByName(kept.select("__doc.*"))
