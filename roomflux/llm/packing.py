"""Best-fit packing planned over a histogram of lengths.

A document's token ids are cut into pieces of at most ``capacity``; only the counts of pieces by length (at most
``capacity`` rows, whatever the input) reach the driver, which runs best-fit decreasing over counts: sequences that are
filled alike are one range, and a step places as many pieces as a range has sequences. The plan says, for each length,
which ranks go to which sequences at which offset; pieces take their slot by a join on rank within length. A rank is the
piece's number among those of its length in its file of the written table, plus the counts in the files before.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomflux.llm.batches import bounded, slices
from roomflux.plans.lineage import materialize

EOS = 2
CAPACITY = 1024
SPECIAL = "<|endoftext|>"
#: The byte-level pattern of the public vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUN = 100_000
SPACES = re.compile(r"\s+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLAN = "length long, first_rank long, n long, first_sequence long, offset long"


class TextEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes, equal to those of the byte-level tokenizer file at ``path``.

    The file's own merges are run by a faster encoder that is built from its vocabulary. The tokenizer itself takes texts that
    hold a special token's string, which it knows as one id, and those with a run of ``RUN`` white-space characters, on which
    the faster one's expression engine gives up.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(x): x for x in kept} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in kept)}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        self.fast = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        odd = SPECIAL in text or len(text) >= RUN and any(m.end() - m.start() >= RUN for m in SPACES.finditer(text))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if odd else self.fast.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; ``part`` and ``nth`` number the pieces of a length within the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = TextEncoder(tokenizer), [0] * (capacity + 1), TaskContext.get().partitionId()
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + EOS.to_bytes(4, "little")
                total = len(ids) // 4
                at = k = 0
                while at < total:
                    n = (total - at - 1) % capacity + 1 if k == 0 else capacity
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), part, seen[n]))
                    seen[n] += 1
                    at, k = at + n, k + 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, n, first sequence, offset), each rank of each length once."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges (first sequence, n) of open sequences
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                n, free, first = -(-left // (capacity // length)), capacity, sequences
                sequences += n
                room.setdefault(free, []).append((first, n))
            first, n = room[free].pop()
            take = min(n, left)
            if take < n:
                room[free].append((first + take, n - take))
            if not room[free]:
                del room[free]
            plan.append((length, rank, take, first, capacity - free))
            if free > length:
                room.setdefault(free - length, []).append((first, take))
            left, rank = left - take, rank + take
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row.

    A null or empty text is its end id alone; repeated rows are packed as often as they come; a null doc_id is kept; equal
    lengths are taken in any order, fixed once the pieces are written; an empty table gives an empty one; columns besides
    doc_id and text are ignored.
    """
    spark: SparkSession = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    files = materialize(cut.groupBy("length", "part").count(), "counts")
    before = files.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in files.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit(counts, capacity), PLAN)
    # The plan's size depends on the capacity alone: ranges of each of at most `capacity` lengths, so it is broadcast.
    slots = F.broadcast(plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "n", "first_sequence", "offset"))).alias("slots")))
    # The counts grow with the files, so they are never broadcast.
    ranked = cut.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")).hint("merge"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    # The last range that starts at or before the rank, by bisection of the sorted array.
    def further(at, k):
        ahead = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((ahead <= F.size("slots")) & (F.try_element_at("slots", ahead)["first_rank"] <= F.col("rank")), ahead).otherwise(at)

    step = F.aggregate(F.sequence(F.lit(20), F.lit(0), F.lit(-1)), F.lit(1), further)
    placed = ranked.join(slots, "length").withColumn("slot", F.element_at("slots", step))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"), F.col("slot.offset").alias("offset"))
