"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned rows of one hashed table: one for the word and one for each n-gram of its
characters' bytes (the word set between marks). A document's vector is the mean over its words, repeats included; a softmax layer gives the
label. Training is minibatch stochastic gradient descent (with per-parameter step sizes) in numpy in one task, over a
bounded, documented number of labelled rows. The output is linear in the mean, so scoring needs one number per table row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from roomflux.llm.batches import bounded, slices
from roomflux.llm.textmodel import fitted, scored, word_hash

BITS = 16
BUCKETS = 1 << BITS
DIM = 8
#: Labelled rows that training takes at most.
LIMIT = 3000
EPOCHS = 3
BATCH = 128
THRESHOLD = 0.3
#: Words whose scores a worker keeps; those of runs longer than KEPT are forgotten after their text.
CACHE = 200_000
KEPT = 64
#: Bytes of distinct words whose n-grams are made at a time; a longer run without white space is taken in pieces that all count.
PIECE = 1 << 20
#: Stands for a word that repeats the word before it.
AGAIN = "\x01again"


def marked(word: str) -> bytes:
    return f"<{word}>".encode("utf-8", "surrogatepass")


def gram_rows(raw: np.ndarray) -> np.ndarray:
    """Table row of each n-gram (three bytes)."""
    raw = raw.astype(np.uint32)
    codes = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word (its own, then those of its n-grams of bytes) one after another, and how many each has."""
    whole = list(map(marked, words))
    raw = np.frombuffer(b"".join(whole), np.uint8)
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    ends = np.cumsum(sizes)
    inside = np.ones(len(raw), bool)
    inside[ends - 1] = inside[ends - 2] = False  # windows that would run into the next word
    rows = np.empty(int(sizes.sum()) - len(words), np.int64)
    grams = np.ones(len(rows), bool)
    first = np.cumsum(sizes - 1) - (sizes - 1)
    grams[first] = False
    rows[grams] = gram_rows(raw)[inside[: len(raw) - 2]]
    rows[first] = np.fromiter(map(word_hash, words), np.int64, len(words)) % BUCKETS
    return rows, sizes - 1


def batched(items: list, size: Callable[[object], int], most: int, count: int) -> Iterator[list]:
    """``items`` in lists of at most ``count``, and of at most ``most`` in size unless one alone is larger."""
    out, held = [], 0
    for x in items:
        n = size(x)
        if out and (len(out) == count or held + n > most):
            yield out
            out, held = [], 0
        out.append(x)
        held += n
    if out:
        yield out


def bag(text: str) -> Counter:
    words = text.split()
    counts = Counter(words)
    again = sum(map(eq, words, words[1:]))
    if again:
        counts[AGAIN] += again
    return counts


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """The log-odds of label 1 that each table row adds, and last the bias."""
    texts, y = [t for t in texts if t.split()], y[[bool(t.split()) for t in texts]] if len(y) else y
    if not len(y):
        return np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, b = np.zeros((DIM, 2)), np.log(np.bincount(y.astype(int), minlength=2) + 1.0)
    b -= b.mean()
    seen_t, seen_w = np.full((BUCKETS, DIM), 1e-6), np.full((DIM, 2), 1e-6)
    order = rng.permutation(len(y))
    batches = []
    for ids in map(np.array, batched(order.tolist(), lambda i: len(texts[i]), 8 * PIECE, BATCH)):
        bags = [bag(texts[i]) for i in ids]
        vocab = {word: k for k, word in enumerate(dict.fromkeys(word for x in bags for word in x))}
        flat, sizes = features(list(vocab))
        word_at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        share = 1.0 / sizes
        doc_at = np.repeat(np.arange(len(bags), dtype=np.int32), [len(x) for x in bags])
        pick = np.fromiter((vocab[word] for x in bags for word in x), np.int32)
        weight = np.fromiter((n / max(1, sum(x.values())) for x in bags for n in x.values()), np.float32)
        batches.append((ids, word_at, flat.astype(np.int32), share, doc_at, pick, weight))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            ids, word_at, flat, share, doc_at, pick, weight = batches[k]
            n_words = len(share)
            vectors = np.stack([np.bincount(word_at, table[flat, d], n_words) for d in range(DIM)], 1) * share[:, None]
            x = np.stack([np.bincount(doc_at, weight * vectors[pick, d], len(ids)) for d in range(DIM)], 1)
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids].astype(int)] -= 1
            p /= len(ids)
            gw, gx = x.T @ p, p @ w.T
            back = np.stack([np.bincount(pick, weight * gx[doc_at, d], n_words) for d in range(DIM)], 1) * share[:, None]
            gt = np.stack([np.bincount(flat, back[word_at, d], BUCKETS) for d in range(DIM)], 1)
            seen_w += gw * gw
            w -= rate * gw / np.sqrt(seen_w)
            b -= rate * p.sum(0)
            touched = np.flatnonzero(gt.any(1))
            seen_t[touched] += gt[touched] ** 2
            table[touched] -= rate * gt[touched] / np.sqrt(seen_t[touched])
    return np.append(table @ (w[:, 1] - w[:, 0]), b[1] - b[0])


class Scorer:
    def __init__(self, odds: np.ndarray):
        self.odds, self.bias, self.cache = odds[:-1], float(odds[-1]), {}

    def _learn(self, words: set) -> None:
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        for some in batched(list(words), len, PIECE, CACHE):
            if len(some[0]) > PIECE:
                self.cache[some[0]] = self._long(some[0])
                continue
            rows, sizes = features(some)
            self.cache.update(zip(some, (np.add.reduceat(self.odds[rows], np.cumsum(sizes) - sizes) / sizes).tolist(), strict=True))

    def _long(self, word: str) -> float:
        raw = np.frombuffer(marked(word), np.uint8)
        total = float(self.odds[word_hash(word) % BUCKETS])
        for at in range(0, len(raw) - 2, PIECE):
            total += float(self.odds[gram_rows(raw[at : at + PIECE + 2])].sum(dtype=np.float64))
        return total / (len(raw) - 1)

    def one(self, text: str) -> float:
        words = text.split()
        found = list(map(self.cache.get, words))
        if None in found:
            missing = {x for x, v in zip(words, found, strict=True) if v is None}
            if len(self.cache) + len(missing) > CACHE:
                missing = set(words)
            self._learn(missing)
            found = list(map(self.cache.__getitem__, words))
            for x in missing:
                if len(x) > KEPT:
                    del self.cache[x]
        again = sum(map(eq, words, words[1:]))
        if again and AGAIN not in self.cache:
            self._learn({AGAIN})
        total = sum(found) + (again * self.cache[AGAIN] if again else 0.0)
        return total / max(1, len(words) + again) + self.bias

    def __call__(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip([self.one(t) for t in texts], -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row's whole text.

    A null or empty text scores by the bias alone; a null doc_id is kept and counts as not held out; rows and labels may
    repeat (of several labels the least counts); without labelled rows every score is 0.5; an empty table gives an empty one;
    of ``docs`` only doc_id and text, of ``labels`` only doc_id and quality are read.
    """
    odds = fitted(docs, labels, "quality", limit, train).astype(np.float32)
    return scored(docs, lambda: Scorer(odds), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; scored as they are read, without a join."""
    import pyarrow as pa

    odds = fitted(docs, labels, "quality", limit, train).astype(np.float32)

    def run(batches):
        score = Scorer(odds)
        for b in slices(batches):
            yield b.filter(pa.array(score([t.as_py() or "" for t in b.column("text")]) >= threshold))

    return bounded(docs).mapInArrow(run, docs.schema)
