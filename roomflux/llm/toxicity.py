"""Toxicity: a convolutional text classifier.

A word is hashed whole and by its first four and five letters, so that unseen inflections of a stem are met too; each hash
names a row of one table of learned embeddings, and a word's embedding is the sum of its rows. Filters of several widths run
over the word sequence, each keeps its maximum over the document (max pooling), and a logistic layer reads the maxima. All
starts from random values and is trained in numpy on four fifths of all labelled rows, share by share. Thresholds are
calibrated by language on the other fifth, counted whole; the language is guessed from function words of the text itself, and
the score is shifted so that 0.5 is the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflux.llm import textmodel
from roomflux.llm.batches import bounded
from roomflux.llm.textmodel import Shares, averaged, scored, shares, steps, word_hash
from roomflux.plans.lineage import release

#: Rows of the embedding table; row 0 stands for no word and is zero.
ROWS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = textmodel.ROUNDS
RATE = 0.2
#: Log-odds beyond which no threshold lies, and thresholds tried for each unit below.
FAR, FINE = 32, 64
THRESHOLD = 0.5
#: Labelled rows of either kind from which on a language has a threshold of its own.
OWN_CUT = 20
CACHE = 200_000
#: Words whose windows are computed at a time.
PIECE = 1 << 16
#: Windows come in multiples of it.
BLOCK = 64
GAP = max(WIDTHS) - 1
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the and of to is that for with was this are by",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "le les des et une dans pour qui sur par avec plus pas au du est",
    "es": "el los las una por con para como del su al lo esta y",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_SPOKEN = {w: k for k, (_, words) in enumerate(FUNCTION_WORDS.items()) for w in words.split()}


def plain(word: str) -> str:
    return word.strip(EDGE).lower()


def row_of(unit: str) -> int:
    return word_hash(unit) % (ROWS - 1) + 1


def units(word: str) -> tuple[int, int, int]:
    """Table rows of a plain word and of its first four and five letters (0 where the word is no longer than that)."""
    return row_of(word) if word else 0, row_of("4:" + word[:4]) if len(word) > 4 else 0, row_of("5:" + word[:5]) if len(word) > 5 else 0


def language(counts: np.ndarray) -> int:
    """Index of the language whose function words are most frequent; the last index for none."""
    return int(counts.argmax()) if counts.any() else len(LANGUAGES)


class Words:
    """Table rows and language of each word, kept while a worker runs."""

    def __init__(self):
        self.cache = {}

    def look(self, text: str) -> tuple[np.ndarray, int]:
        codes, spoken = self.codes(text)
        return rows_of(codes), spoken

    def codes(self, text: str) -> tuple[np.ndarray, int]:
        """For each word its table rows and language in one number, and the language of all."""
        words = text.split()
        found = list(map(self.cache.get, words))
        if None in found:
            missing = {x for x, v in zip(words, found, strict=True) if v is None}
            if len(self.cache) + len(missing) > CACHE:
                self.cache.clear()
                missing = set(words)
            for x in missing:
                y = plain(x)
                whole, four, five = units(y)
                self.cache[x] = whole << 35 | four << 19 | five << 3 | _SPOKEN.get(y, 7)
            found = list(map(self.cache.__getitem__, words))
        every = np.array(found, np.int64) if found else np.zeros(0, np.int64)
        return every, language(np.bincount(every & 7, minlength=8)[: len(LANGUAGES)])


def rows_of(codes: np.ndarray) -> np.ndarray:
    """The table rows of each word."""
    return np.stack([codes >> 35, codes >> 19 & (ROWS - 1), codes >> 3 & (ROWS - 1)], 1)


class Model(NamedTuple):
    """``filters``: for each width an array (place in the window, DIM, FILTERS). ``cut``: log-odds at the threshold, by language, last for none."""

    table: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    w: np.ndarray
    b: float
    cut: np.ndarray


def laid(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents one after another, each followed by rows of no word, and where their windows begin and end (one over no words included)."""
    none = np.zeros((GAP + 1, 3), np.int64)
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes + len(none)) - (sizes + len(none))
    return np.concatenate([x for d in docs for x in (d, none)]), starts, starts + sizes + 1


def responses(model: Model, ids: np.ndarray) -> list[np.ndarray]:
    """Of each width, what its filters give for the window that begins at each row but the last ``GAP``."""
    n = len(ids) - GAP
    whole = -(-n // BLOCK) * BLOCK  # no row is multiplied in a shorter block, which might round otherwise
    words = np.zeros((whole + GAP, DIM), np.float32)
    model.table[ids].sum(1, out=words[: len(ids)])
    return [sum(words[k : k + whole] @ f[k] for k in range(len(f)))[:n] for f in model.filters]


def pieced(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray]]:
    """Table rows of some documents at a time, and of each piece there the document and where its windows begin and end.

    A long document is laid out in pieces that go on for ``GAP`` words, so that each window is met once.
    """
    pieces, own, upto = [], [], []
    for k, d in enumerate(docs):
        for at in range(0, max(1, len(d)), PIECE):
            pieces.append(d[at : at + PIECE + GAP])
            own.append(k)
            upto.append(min(PIECE, len(d) - at + (at + PIECE >= len(d))))
    at = 0
    while at < len(pieces):
        n, held = at, 0
        while n < len(pieces) and (n == at or held + len(pieces[n]) <= PIECE):
            held += len(pieces[n])
            n += 1
        ids, starts, _ = laid(pieces[at:n])
        yield ids, own[at:n], starts, starts + np.array(upto[at:n])
        at = n


def logits(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Log-odds of each document."""
    top = np.zeros((len(docs), len(WIDTHS), FILTERS))  # the window over no words gives zero
    for ids, own, starts, ends in pieced(docs):
        cuts = np.stack([starts, ends], 1).ravel()
        for k, out in enumerate(responses(model, ids)):
            np.maximum.at(top[:, k], own, np.maximum.reduceat(out, cuts[:-1] if cuts[-1] >= len(out) else cuts)[::2])
    return np.maximum(top + model.shift, 0).reshape(len(docs), -1) @ model.w + model.b


def peaks(model: Model, docs: list[np.ndarray]) -> list[np.ndarray]:
    """Of each width the table rows of the window that responds most: by document, filter and place in the window."""
    best = np.full((len(docs), len(WIDTHS), FILTERS), -np.inf)
    found = [np.zeros((len(docs), FILTERS, k, 3), np.int64) for k in WIDTHS]
    for ids, own, starts, ends in pieced(docs):
        for k, out in enumerate(responses(model, ids)):
            for doc, lo, hi in zip(own, starts, ends, strict=True):
                places = lo + out[lo:hi].argmax(0)
                value = out[places, np.arange(FILTERS)]
                more = value > best[doc, k]
                best[doc, k, more] = value[more]
                found[k][doc, more] = ids[places[more, None] + np.arange(WIDTHS[k])]
    return found


#: Numbers of a model's table, filters, shift, w and b, one after another in a vector.
SHAPES = [(ROWS, DIM), *((k, DIM, FILTERS) for k in WIDTHS), (len(WIDTHS), FILTERS), (len(WIDTHS) * FILTERS,), (1,)]
_ENDS = np.cumsum([int(np.prod(shape)) for shape in SHAPES])


def views(theta: np.ndarray) -> list[np.ndarray]:
    return [x.reshape(shape) for x, shape in zip(np.split(theta, _ENDS[:-1]), SHAPES, strict=True)]


def model_of(theta: np.ndarray) -> Model:
    table, *filters, shift, w, b = views(theta)
    return Model(table, filters, shift, w, float(b[0]), np.zeros(len(LANGUAGES) + 1))


def start(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of random values and their sums of squared gradients."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(_ENDS[-1], np.float32)
    table, *filters, _, w, b = views(theta)
    table[1:] = rng.normal(0, 0.1, (ROWS, DIM))[1:]
    for f in filters:
        f[:] = rng.normal(0, 0.3, f.shape)
    w[:] = rng.normal(0.3, 0.1, w.shape)
    b[:] = -2
    return theta, np.full(len(theta), 1e-6, np.float32)


def weight_of_toxic(clean: int, toxic: int) -> float:
    return min(8.0, max(1.0, clean / max(1, toxic)))


def learn(theta: np.ndarray, mass: np.ndarray, batches: Iterator, turn: int, heavy: float) -> None:
    """Gradient descent with a step size for each parameter; only the window of each maximum passes a gradient on."""
    model, (table, *filters, shift, w, b), (seen_table, *seen) = model_of(theta), views(theta), views(mass)
    rate = RATE * (1 - 0.8 * turn / EPOCHS)

    def step(p: np.ndarray, own: np.ndarray, g: np.ndarray) -> None:
        own += g * g
        p -= rate * g / np.sqrt(own)

    for codes, y, _ in batches:
        found = peaks(model, [rows_of(d) for d in codes])
        words = [table[ids].sum(3) for ids in found]
        top = np.stack([np.einsum("dfje,jef->df", x, f) for x, f in zip(words, filters, strict=True)], 1) + shift
        act = np.maximum(top, 0).reshape(len(y), -1)
        g = np.where(y == 1, heavy, 1.0) * (1 / (1 + np.exp(-np.clip(act @ w + b[0], -30, 30))) - y) / len(y)
        back = (g[:, None] * w).reshape(top.shape) * (top > 0)
        rows = np.concatenate([ids.reshape(-1, 3) for ids in found])
        values = np.concatenate([np.einsum("df,jef->dfje", back[:, k], f).reshape(-1, DIM) for k, f in enumerate(filters)])
        for k, f in enumerate(filters):
            step(f, seen[k], np.einsum("df,dfje->jef", back[:, k], words[k]))
        step(shift, seen[-3], back.sum(0))
        step(w, seen[-2], act.T @ g)
        seen[-1] += g.sum() ** 2
        b -= rate * g.sum()
        met, place = np.unique(rows, return_inverse=True)
        place, grad = place.ravel(), np.empty((len(met), DIM))
        values = np.repeat(values, 3, axis=0)
        for e in range(DIM):
            grad[:, e] = np.bincount(place, values[:, e], len(met))
        grad[met == 0] = 0
        seen_table[met] += grad * grad
        table[met] -= rate * grad / np.sqrt(seen_table[met])


def best_cut(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of rising ``z``, of which each has some clean and toxic rows, that makes fewest errors, in the middle between two values."""
    errors = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    k = np.flatnonzero(errors == errors.min())
    k = int(k[len(k) // 2])  # the middle one among equals
    low, high = z[k - 1] if k else z[0] - 1, z[k] if k < len(z) else z[-1] + 1
    return float((low + high) / 2)


def cells(model: Model, batches: Iterator) -> dict[tuple[int, int], np.ndarray]:
    """Clean and toxic rows by language and log-odds in units of 1 / ``FINE``."""
    out = {}
    for codes, y, spoken in batches:
        z = np.rint(np.clip(logits(model, [rows_of(d) for d in codes]), -FAR, FAR) * FINE).astype(int).tolist()
        for key, toxic in zip(zip(spoken.tolist(), z, strict=True), y.astype(int).tolist(), strict=True):
            out.setdefault(key, np.zeros(2, np.int64))[toxic] += 1
    return out


def calibrated(model: Model, counts: dict[tuple[int, int], np.ndarray]) -> Model:
    """With the cut that makes fewest errors, by language; languages with few toxic rows take that of all rows."""
    table = np.zeros((len(LANGUAGES) + 1, 2 * FAR * FINE + 1, 2), np.int64)
    for (k, z), n in counts.items():
        table[k, z + FAR * FINE] += n

    def cut_of(own: np.ndarray) -> float:
        met = np.flatnonzero(own.any(1))
        return best_cut((met - FAR * FINE) / FINE, own[met, 0], own[met, 1])

    if not table.sum((0, 1)).all():
        return model
    cut = np.full(len(LANGUAGES) + 1, cut_of(table.sum(0)))
    for k in range(len(LANGUAGES)):
        if table[k].sum(0).min() >= OWN_CUT:
            cut[k] = cut_of(table[k])
    return model._replace(cut=cut)


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> tuple | None:
    """The fields of a model of texts in memory, fitted on four fifths of them and calibrated on the others."""
    if not len(y):
        return None
    words = Words()
    rows = [(0, v, spoken, codes) for v, (codes, spoken) in zip(y, map(words.codes, texts), strict=True)]
    n = -(-4 * len(y) // 5)
    heavy = weight_of_toxic((y[:n] == 0).sum(), (y[:n] == 1).sum())
    theta, mass = start(seed)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        learn(theta, mass, steps(rows[i] for i in rng.permutation(n)), epoch * EPOCHS // epochs, heavy)
    model = model_of(theta)
    return tuple(calibrated(model, cells(model, steps(rows[n:]))))


def trained(found: Shares) -> Model:
    """The model of all rows of ``found``: fitted on those of its parts, calibrated on those left out, which are counted where they lie."""
    heavy = weight_of_toxic(*found.counts)
    theta, _ = averaged(found, *start(), lambda theta, mass, batches, turn: learn(theta, mass, batches, turn, heavy))
    model = model_of(theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = cells(model, steps(textmodel.rows_in(batches)))
        made = [(*key, *n) for key, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in range(4)], names=["kind", "z", "clean", "toxic"])

    counted = bounded(found.rows.where("part < 0")).mapInArrow(run, "kind long, z long, clean long, toxic long")
    counted = counted.groupBy("kind", "z").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    return calibrated(model, {(r["kind"], r["z"]): np.array([r["clean"], r["toxic"]]) for r in counted})


class Scorer:
    def __init__(self, model: Model):
        self.words, self.model = Words(), model

    def __call__(self, texts: list[str]) -> np.ndarray:
        looked = [self.words.look(t) for t in texts]
        out = logits(self.model, [d for d, _ in looked]) - self.model.cut[[k for _, k in looked]]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row's whole text.

    A null or empty text has no words and scores as such; a null doc_id is kept and counts as not held out; rows and labels
    may repeat (of several labels the least counts); without labelled rows every score is 0.5; an empty table gives an empty
    one; of ``docs`` only doc_id and text, of ``labels`` only doc_id and toxic are read. All labelled rows outside the
    held-out fold are learned from: four fifths train the model, the others give its thresholds.
    """
    found = shares(docs, labels, "toxic", lambda: Words().codes)
    model = trained(found) if sum(found.counts) else None
    release(found.rows)
    if model is None:
        return scored(docs, lambda: lambda texts: np.full(len(texts), 0.5), threshold)
    return scored(docs, lambda: Scorer(model), threshold)
