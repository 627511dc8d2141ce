"""Toxicity by subword-bag embeddings averaged into a linear softmax of two classes.

A word's bag: the word and its character n-grams of 3 to 5, hashed to `BUCKETS` rows of an embedding table; its vector is
their mean. A window's vector is the mean of its words' vectors, and goes through the softmax. A text is as toxic as its
most toxic window, so that an insult in a long text counts in full; windows of one word find the most (README).

Table and softmax are trained jointly with numpy, by Adagrad from random values, on windows that have their document's
label: first on `some` random ones of each document, then, as most windows of a toxic document are harmless, on those of it
that are most toxic so far, and of a clean one on its most toxic ones and random others. In every step only a share `kept` of
each bag's rows is used, drawn at random, so that no row carries a word alone, and a misspelling that keeps n-grams keeps a
part of the word's weight.

Training uses a bounded sample (documented by the parameters of Training): labelled rows in folds other than the
held-out one, of at most `most_chars` characters, the `rows` first of each class in the order of a hash of their ids.

Since the head is linear, a subword has one number when the model is applied: a table of 2**18 floats, 1 MB, goes to the
executors.

Defined cases: null, empty and wordless texts score what a text without any window scores (the intercept alone); with one
class or none in the sample, so also for an empty table of labels, every score is 0; an empty table of documents gives no
rows; of a document labelled twice the label 1 counts; very long texts are scored whole; repeated rows count each; only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import WordTable, fold, map_batches, materialise

BUCKETS = 1 << 18
_WORD = re.compile(r"[^\W_]+")
#: The top of a text without words.
NOTHING = -20.0


@dataclass(frozen=True)
class Training:
    rows: int = 1500
    most_chars: int = 8000
    window: int = 1
    dim: int = 2
    first: int = 12
    some: int = 30
    rounds: int = 40
    steps: int = 3
    kept: float = 0.3
    rate: float = 1.0
    seed: int = 7
    threshold: float = 0.7
    folds: int = 3
    held_out: int = 1


def subwords(word: str) -> list[int]:
    """Rows of a word: itself and its character n-grams of 3 to 5 with the word's ends marked."""
    b = f"<{word}>".encode("utf-8", "surrogatepass")
    crc, mask = zlib.crc32, BUCKETS - 1
    return [crc(b) & mask] + [crc(b[i : i + k]) & mask for k in (3, 4, 5) for i in range(len(b) - k + 1)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # a subword's part of the logit
    bias: float
    slope: float
    offset: float

    window: int = 1

    def scorer(self):
        """A function from a text to the logit of its most toxic window."""
        table = self.table.tolist()

        def of(word: str) -> float:
            rows = subwords(word)
            return sum([table[r] for r in rows]) / len(rows)

        known = WordTable(of)

        def top(text: str | None) -> float:
            values = [known[w] for w in words_of(text)]
            if not values:
                return NOTHING
            if len(values) <= self.window:
                return self.bias + sum(values) / len(values)
            total = np.concatenate(([0.0], np.cumsum(values)))
            return self.bias + float((total[self.window :] - total[: -self.window]).max()) / self.window

        return top

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.offset, -60, 60)))


class Net:
    """Embedding table and softmax, over the words of a sample."""

    def __init__(self, words: list[str], how: Training):
        self.rng, self.rate = np.random.default_rng(how.seed), how.rate
        bags = [np.array(subwords(w), np.int64) for w in words]
        self.rows, self.length, self.kept = np.concatenate(bags), np.array([len(b) for b in bags]), how.kept
        self.start = np.cumsum(self.length) - self.length
        self.emb = self.rng.normal(0, 0.1, (BUCKETS, how.dim))
        self.head, self.bias = self.rng.normal(0, 1, (how.dim, 2)), np.zeros(2)
        self.seen, self.head_seen, self.bias_seen = np.full((BUCKETS, how.dim), 1e-3), np.full((how.dim, 2), 1e-3), np.full(2, 1e-3)

    def _sums(self, index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, values[:, d], size) for d in range(values.shape[1])], 1)

    def logits(self) -> np.ndarray:
        """Of each word: its part of the logit of class 1 against class 0."""
        return np.add.reduceat((self.emb @ (self.head[:, 1] - self.head[:, 0]))[self.rows], self.start) / self.length

    def step(self, words: np.ndarray, group: np.ndarray, label: np.ndarray) -> None:
        """words: indices; group: of each the window that it is in; label: of each window. Classes weigh the same."""
        own, words = np.unique(words, return_inverse=True)
        size = self.length[own]
        of = np.repeat(np.arange(len(own)), size)
        rows = self.rows[np.repeat(self.start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        use = self.rng.random(len(rows)) < self.kept
        rows, of = rows[use], of[use]
        n = np.maximum(np.bincount(of, minlength=len(own)), 1)[:, None]
        vectors = self._sums(of, self.emb[rows], len(own)) / n
        length = np.bincount(group, minlength=len(label))[:, None]
        mean = self._sums(group, vectors[words], len(label)) / length
        z = mean @ self.head + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        error = p * (len(label) / 2 / np.maximum(np.bincount(label, minlength=2), 1))[label][:, None]
        back = (error @ self.head.T / length)[group]
        grad = self._sums(rows, (self._sums(words, back, len(own)) / n)[of], BUCKETS)
        for value, slope, seen, rate in ((self.emb, grad, self.seen, self.rate), (self.head, mean.T @ error / len(label), self.head_seen, self.rate / 5), (self.bias, error.mean(0), self.bias_seen, self.rate / 5)):
            seen += slope * slope
            value -= rate * slope / np.sqrt(seen)


def fit(texts: list[str], toxic: list[int], how: Training = Training()) -> Model | None:  # noqa: B008
    """Trains on the given documents; None where a class is missing."""
    y = np.asarray(toxic)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
    if len(set(toxic)) < 2 or not index:
        return None
    rng = np.random.default_rng(how.seed)
    left_out = rng.random(len(y)) < 0.25
    net = Net(list(index), how)

    def window_means(z: np.ndarray, doc: np.ndarray) -> np.ndarray:
        total, w = np.concatenate(([0.0], np.cumsum(z[doc]))), min(how.window, len(doc))
        return (total[w:] - total[:-w]) / w

    train = [i for i in range(len(docs)) if not left_out[i] and len(docs[i])]
    if len(set(y[train])) < 2:
        train = [i for i in range(len(docs)) if len(docs[i])]

    def windows(picks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, window and label of windows that start at picks[k] in the k-th document."""
        found = [docs[i][a : a + how.window] for i, at in zip(train, picks, strict=True) for a in at.tolist()]
        return np.concatenate(found), np.repeat(np.arange(len(found)), list(map(len, found))), np.repeat(y[train], list(map(len, picks)))

    starts = [max(len(docs[i]) - how.window + 1, 1) for i in train]
    for _ in range(how.first):
        net.step(*windows([rng.integers(0, n, min(n, how.some)) for n in starts]))
    for _ in range(how.rounds):
        z, bias = net.logits(), net.bias[1] - net.bias[0]
        picks = []
        for i in train:
            mean = window_means(z, docs[i])
            if y[i]:
                picks.append(np.union1d([mean.argmax()], np.flatnonzero(mean + bias > 2)))
            else:
                picks.append(np.union1d(np.argsort(mean)[-4:], rng.choice(len(mean), min(6, len(mean)), replace=False)))
        chosen = windows(picks)
        for _ in range(how.steps):
            net.step(*chosen)

    z, bias = net.logits(), net.bias[1] - net.bias[0]
    top = np.array([bias + window_means(z, d).max() if len(d) else NOTHING for d in docs])
    use = left_out if len(set(y[left_out])) == 2 else np.ones(len(y), bool)
    slope, offset = 1.0, 0.0
    x, t = np.clip(top[use], -30, 30), y[use].astype(float)
    for _ in range(50):  # Newton steps with a small ridge that keeps a separable sample finite
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * x).sum() + 0.05 * (slope - 1), (p - t).sum() + 0.05 * offset])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        move = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(move[0], -1, 1), offset - np.clip(move[1], -2, 2)
    return Model((net.emb @ (net.head[:, 1] - net.head[:, 0])).astype(np.float32), float(bias), float(slope), float(offset), how.window)


def sample(docs: DataFrame, labels: DataFrame, how: Training) -> tuple[list[str], list[int]]:
    """The bounded training sample: at most 2 * rows texts of at most most_chars characters."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold(F.col("doc_id")) % how.folds != how.held_out).withColumn("order", F.xxhash64("doc_id", F.lit(how.seed)))
    # Ids first, of rows that can be used, then the texts of these few.
    usable = docs.where(F.length("text").between(1, how.most_chars)).select("doc_id").distinct()
    marks = materialise(marks.join(usable, "doc_id"), "marks")
    ids = reduce(DataFrame.unionByName, [marks.where(F.col("toxic") == kind).orderBy("order", "doc_id").limit(how.rows) for kind in (0, 1)])
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, how.most_chars)).join(F.broadcast(ids), "doc_id")
    out: list[tuple[str, int]] = []
    for kind in (0, 1):
        rows = texts.where(F.col("toxic") == kind).orderBy("order", "doc_id", F.xxhash64("text")).limit(how.rows).select("text").collect()
        out += [(r[0], kind) for r in rows]
    return [t for t, _ in out], [k for _, k in out]


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model | None:  # noqa: B008
    return fit(*sample(docs, labels, how), how)


def apply(docs: DataFrame, model: Model | None, how: Training = Training()) -> DataFrame:  # noqa: B008
    """docs with `score` and `predicted`. The id's fold plays no part here."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        top = model.scorer() if model else None
        for b in batches:
            texts = b.column("text").to_pylist()
            score = model.score(np.array([top(t) for t in texts], float)) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array((score >= how.threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{schema}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:  # noqa: B008
    out = apply(docs.select("doc_id", "text"), train(docs, labels, how), how)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) % how.folds == how.held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:  # noqa: B008
    """The documents that aren't predicted toxic."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return apply(docs.select(*columns), train(docs, labels, how), how).where("predicted = 0").select(*columns)
