"""What the text classifiers share: labelled rows, held-out folds, training in shares, hashes of words and per-row scoring."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflux.llm.batches import bounded, slices
from roomflux.llm.spans import likely
from roomflux.plans.lineage import materialize

FOLDS = 5
#: Labelled rows of a share, about; shares are trained side by side and averaged after each round.
SHARE = 16_000
ROUNDS = 8
#: Rows that a share passes in all rounds, about: few are met in each round, many in ``LEAST`` rounds at least.
VISITS = 32_000
LEAST = 2
#: One of so many labelled rows of a share is left out of the training, for thresholds.
LEFT_OUT = 5
#: Rows and codes that a step takes at a time (one longer row is taken alone), and parameters that are averaged at a time.
BATCH, CODES = 32, 1 << 18
#: Codes of the rows that are put in another order each round.
MIXED = 1 << 22
CHUNK = 1 << 13
#: Characters of the labelled texts that training takes at most.
CHARS = 64_000_000


def held_out(doc_id):
    """Whether a row belongs to the fold that labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y of the labelled ids outside the held-out fold; of several labels of an id the least."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("y").alias("y"))


class Shares(NamedTuple):
    """``rows``: share, part (below ``ROUNDS``; -1 if left out), y, kind, codes. ``counts``: training rows of label 0 and 1. ``met``: rounds that meet a row."""

    rows: DataFrame
    counts: tuple[int, int]
    met: int


def shares(docs: DataFrame, labels: DataFrame, label: str, make: Callable[[], Callable[[str], tuple[np.ndarray, int]]]) -> Shares:
    """Every labelled row outside the held-out fold, whole, as codes (and a kind) that the function built by ``make`` gives for its text.

    Rows are dealt to shares by a hash of doc_id and ordered by another, so that reruns agree; repeated rows count once. The
    texts that have no label are told apart by a bitmap of fixed size, the others meet their labels in the task of their share,
    which gets both in order, the label first: texts are shuffled once, codes never. A share is written as one file and read by
    one task, row after row: no task holds more of it than a step takes.
    """
    rows = learnable(labels, label)
    n = max(1, -(-rows.count() // SHARE))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    text = likely(text.withColumn("__hash", F.xxhash64("doc_id")), "__hash", rows.select(F.xxhash64("doc_id"))).where("likely").select("doc_id", "text")
    own = F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(n)).cast("int").alias("share"), F.xxhash64(F.lit("order"), "doc_id").alias("place")
    marks = rows.select(*own, F.lit(None).cast("long").alias("of"), "doc_id", "y", F.lit(None).cast("string").alias("text"))
    found = marks.unionByName(text.select(*own, F.xxhash64("text").alias("of"), "doc_id", F.lit(None).cast("int").alias("y"), "text"))
    found = found.repartitionById(n, F.col("share")).sortWithinPartitions("share", "place", "doc_id", F.col("text").isNotNull(), "of")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, last, mark = make(), {}, None, (None, None)
        for s in slices(batches):
            made = []
            for share, doc, of, y, text in zip(*(s.column(c).to_pylist() for c in ("share", "doc_id", "of", "y", "text")), strict=True):
                if text is None:
                    mark = doc, y
                elif doc == mark[0] and (doc, of, text) != last:
                    block, k = divmod(at.get(share, 0), LEFT_OUT)
                    part = -1 if k == LEFT_OUT - 1 else (block * (LEFT_OUT - 1) + k) % ROUNDS
                    at[share], last = at.get(share, 0) + 1, (doc, of, text)
                    codes, kind = encode(text)
                    made.append((share, part, mark[1], kind, codes))
            if made:
                columns = [pa.array([x[k] for x in made], pa.int32()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, listed([x[4] for x in made])], names=["share", "part", "y", "kind", "codes"])

    kept = materialize(bounded(found).mapInArrow(deal, "share int, part int, y int, kind int, codes array<long>"), "shares")
    counts = {r["y"]: r["count"] for r in kept.where("part >= 0").groupBy("y").count().collect()}
    per_share = sum(counts.values()) // n
    return Shares(kept, (counts.get(0, 0), counts.get(1, 0)), max(LEAST, min(ROUNDS, VISITS // max(1, per_share))))


def listed(codes: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pa.array(np.concatenate(codes), pa.int64()))


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Share, y, kind and codes of each row."""
    for b in batches:
        lists = b.column("codes")
        upto, codes = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("share", "y", "kind")), strict=True)):
            yield *row, codes[upto[k] : upto[k + 1]]


def mixed(rows: Iterator[tuple[int, int, int, np.ndarray]], seed: tuple[int, ...]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """The rows, ``MIXED`` codes at a time in a random order."""
    rng, held, codes = np.random.default_rng(seed), [], 0
    for row in rows:
        held.append(row)
        codes += len(row[-1])
        if codes >= MIXED:
            yield from (held[i] for i in rng.permutation(len(held)))
            held, codes = [], 0
    yield from (held[i] for i in rng.permutation(len(held)))


def steps(rows: Iterator[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Codes, y and kinds of some rows at a time."""
    out, held = [], 0
    for row in rows:
        if out and (len(out) == BATCH or held + len(row[-1]) > CODES):
            yield [x[-1] for x in out], np.array([x[1] for x in out]), np.array([x[2] for x in out])
            out, held = [], 0
        out.append(row)
        held += len(row[-1])
    if out:
        yield [x[-1] for x in out], np.array([x[1] for x in out]), np.array([x[2] for x in out])


def averaged(found: Shares, theta: np.ndarray, mass: np.ndarray, learn: Callable[[np.ndarray, np.ndarray, Iterator, int], None]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and their sums of squared gradients (float32 vectors) after all rounds.

    ``learn`` takes parameters, sums, steps and the round, and changes the first two. In a round each share starts from the
    same parameters and passes its rows of ``found.met`` parts; the changes of each parameter are averaged by the squared
    gradients that the shares met there, so that what few shares know is not thinned out by the others. All labelled rows
    but those left out are passed, in ``found.met`` rounds each. The driver gets the averages alone, whatever the rows.
    """
    chunks = range(0, len(theta), CHUNK)
    for turn in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], theta=theta, mass=mass, turn=turn) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(theta)), np.float32)
            for share, own in groupby(rows_in(batches), lambda row: row[0]):
                now, seen = theta.copy(), mass.copy()
                learn(now, seen, steps(mixed(own, (share, turn))), turn)
                seen -= mass
                total += seen * (now - theta), seen, seen > 0
            met = [k for k, at in enumerate(chunks) if total[1, at : at + CHUNK].any()]
            if met:
                task = TaskContext.get().partitionId()
                sums = [np.ascontiguousarray(total[:, chunks[k] : chunks[k] + CHUNK]).tobytes() for k in met]
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([task] * len(met), pa.int32()), pa.array(sums, pa.binary())], names=["chunk", "task", "sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = ((chunk, one.as_py()) for b in batches for chunk, one in zip(b.column("chunk").to_pylist(), b.column("sums"), strict=True))
            for chunk, own in groupby(sums, lambda x: x[0]):
                change, seen, n = sum(np.frombuffer(x, np.float32).reshape(3, -1).astype(np.float64) for _, x in own)
                out = np.stack([np.divide(change, seen, out=np.zeros_like(seen), where=seen > 0), seen / np.maximum(n, 1)])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "means"])

        parts = [(turn + k) % ROUNDS for k in range(found.met)]
        sums = bounded(found.rows.where(F.col("part").isin(parts))).mapInArrow(run, "chunk int, task int, sums binary")
        means = sums.repartition("chunk").sortWithinPartitions("chunk", "task").mapInArrow(merge, "chunk int, means binary").collect()
        theta, mass = theta.copy(), mass.copy()
        for r in means:
            change, seen = np.frombuffer(r["means"], np.float32).reshape(2, -1)
            theta[r["chunk"] * CHUNK :][: len(change)] += change
            mass[r["chunk"] * CHUNK :][: len(seen)] += seen
    return theta, mass


def fitted(docs: DataFrame, labels: DataFrame, label: str, limit: int, train: Callable[[list[str], np.ndarray], object], chars: int = CHARS):
    """What ``train`` makes of at most ``limit`` labelled texts outside the held-out fold, taken in a fixed pseudo-random order.

    The rows are those whose doc_id has the least hashes, so a rerun takes the same ones; repeated rows count once, and of
    several labels of an id the least. Whole texts are taken until ``chars`` characters are reached. At most ``limit`` ids are
    broadcast. The training runs in one task over this bounded sample, and the driver gets the trained model alone.
    """
    rows = learnable(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").limit(limit).select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, held = [], [], 0
        for b in batches:
            for one, text in zip(b.column("y").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                if held <= chars and (held := held + len(text)) <= chars:
                    texts.append(text)
                    y.append(one)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(y, np.float64)))], pa.binary())], names=["model"])

    made = bounded(found).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0))


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def scored(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; ``make`` builds, once a task, the function that scores whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for s in slices(batches):
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("held_out"), pa.array(score([t.as_py() or "" for t in s.column("text")]), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    return bounded(rows).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
