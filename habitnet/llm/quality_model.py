"""A quality classifier on random-indexing word vectors.

Words are hashed to ``BUCKETS``. Every bucket owns a sparse random index vector
(a few entries of plus or minus one); a bucket's word vector is the sum of the
index vectors of all words seen within ``REACH`` places of it, over all
documents. The sums are whole numbers added up by Spark, so the vectors don't
depend on how the documents are partitioned; the table has a fixed size.

A document is the mean and the spread of its words' vectors and how much
neighbours agree. A network of two layers, trained with numpy on a bounded
sample of labelled rows, scores it; a temperature fitted on a part of the
sample that the network hasn't seen calibrates the probabilities.

Defined cases: null and empty texts have zero features and get the network's
score for those; without labelled rows of both classes every score is the share
of label 1 among them (0.5 if there are none); repeated rows score alike.
Texts are read whole; an empty table gives no rows; a score equal to the threshold
counts as label 1, and labelled rows that tie for the sample are taken by id. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitnet.llm.common import map_batches, texts_of
from habitnet.llm.labelled import HELD_OUT_FOLD, fold, sample

BUCKETS = 1 << 13
DIMENSIONS = 32
ENTRIES = 4
REACH = 2
#: The most labelled documents of each class that the network learns from.
ROWS_PER_CLASS = 10_000
HIDDEN = 24
EPOCHS = 400
SEED = 7
THRESHOLD = 0.7
#: Words handled at a time, so that a very long text needs bounded memory.
WORDS_AT_ONCE = 1 << 16
_TOKEN = re.compile(r"\w+|[^\w\s]")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def buckets(text: str, known: _Buckets) -> np.ndarray:
    found = _TOKEN.findall(text)
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places, rng.choice([-1, 1], (BUCKETS, ENTRIES))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    places, signs = index_vectors()
    known, total = _Buckets(), np.zeros(BUCKETS * DIMENSIONS)

    def add(words: np.ndarray, neighbours: np.ndarray) -> None:
        for e in range(ENTRIES):
            np.add(total, np.bincount(words * DIMENSIONS + places[neighbours, e], signs[neighbours, e], len(total)), out=total)

    def flush(texts: list[np.ndarray]) -> None:
        for step in range(1, REACH + 1):
            left = np.concatenate([t[:-step] for t in texts])
            right = np.concatenate([t[step:] for t in texts])
            for at in range(0, len(left), 1 << 20):
                span = slice(at, at + (1 << 20))
                add(left[span], right[span])
                add(right[span], left[span])

    waiting, size = [], 0
    for batch in batches:
        for text in texts_of(batch):
            waiting.append(buckets(text, known))
            size += len(waiting[-1])
            if size >= 1 << 19:
                flush(waiting)
                waiting, size = [], 0
    if waiting:
        flush(waiting)
    table = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
    used = np.flatnonzero(table.any(axis=1))
    yield {"bucket": used} | {f"c{d}": table[used, d] for d in range(DIMENSIONS)}


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of word vectors, centred and scaled to length one (unseen buckets: zero)."""
    names = [f"c{d}" for d in range(DIMENSIONS)]
    own = docs.select(F.col(f"`{text}`").alias("text"))
    sums = map_batches(own, _contexts, ", ".join(["bucket int", *(f"{n} long" for n in names)]))
    rows = sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # BUCKETS rows at most
    table = np.zeros((BUCKETS, DIMENSIONS))
    table[rows["bucket"].to_numpy(int)] = rows[names].to_numpy(float)
    seen = table.any(axis=1)
    if seen.any():
        table[seen] /= np.linalg.norm(table[seen], axis=1, keepdims=True)
        table[seen] -= table[seen].mean(axis=0)
        table[seen] /= np.maximum(np.linalg.norm(table[seen], axis=1, keepdims=True), 1e-9)
    return table.astype(np.float32)


def features(text: str, vectors: np.ndarray, known: _Buckets) -> np.ndarray:
    """Mean and spread of the word vectors, mean agreement of neighbours one and two apart, log of the length."""
    ids = buckets(text, known)
    total, square, agree = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(2)
    for at in range(0, len(ids), WORDS_AT_ONCE):
        own = vectors[ids[at : at + WORDS_AT_ONCE + 2]]
        inner = own[: WORDS_AT_ONCE]
        total += inner.sum(axis=0, dtype=float)
        square += np.einsum("ij,ij->j", inner, inner, dtype=float)
        for step in (1, 2):
            later = own[step : step + WORDS_AT_ONCE]
            agree[step - 1] += np.einsum("ij,ij->", own[: len(later)], later, dtype=float)
    n = max(len(ids), 1)
    return np.concatenate([total / n, square / n, agree / n, [np.log1p(len(ids))]])


def _features_udf(vectors):
    def run(texts: pd.Series) -> pd.Series:
        known = _Buckets()
        return pd.Series([features(t if isinstance(t, str) else "", vectors.value, known).tolist() for t in texts.tolist()])

    return F.pandas_udf(run, "array<double>")


class Network:
    """Standardised inputs, one hidden layer of tanh, a logistic output divided by a temperature."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights, self.temperature = prior, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on minibatches of the mean logistic loss with a small weight decay."""
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step, size = 0, min(len(z), 512)
        for _ in range(max(1, EPOCHS * size // len(z)) + 20):
            order = rng.permutation(len(z))
            for at in range(0, len(z), size):
                i = order[at : at + size]
                h = np.tanh(z[i] @ w[0] + w[1])
                error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -500, 500))) - y[i]) / len(i)
                back = np.outer(error, w[2]) * (1 - h * h)
                gradients = [z[i].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ error + 1e-4 * w[2], error.sum()]
                step += 1
                for k, g in enumerate(gradients):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] = w[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights = w

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least logistic loss, on a grid."""
        if not len(y):
            return
        margin = np.where(y == 1, 1, -1) * self.logits(x)
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, -margin / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> Network:
    rows = sample(docs, labels, label, rows_per_class).select("label", "part", _features_udf(vectors)("text").alias("x"))
    rows = rows.orderBy(F.xxhash64("x"), "label").toPandas()  # 4 * rows_per_class rows at most
    y = rows["label"].to_numpy(int)
    network = Network(float(y.mean()) if len(y) else 0.5)
    part = rows["part"].to_numpy(bool)
    if len(set(y[~part])) == 2:
        x = np.array(rows["x"].tolist())
        network.fit(x[~part], y[~part])
        network.calibrate(x[part], y[part])
    return network


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))  # BUCKETS x DIMENSIONS floats: 1 MB
    network = train(docs, labels, vectors, label)

    def run(texts: pd.Series) -> pd.Series:
        known = _Buckets()
        x = [features(t if isinstance(t, str) else "", vectors.value, known) for t in texts.tolist()]
        return pd.Series(network.scores(np.array(x).reshape(len(x), -1)))

    score = F.pandas_udf(run, "double").asNondeterministic()
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
