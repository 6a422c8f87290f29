"""Importance resampling towards a target distribution over hashed n-grams.

Texts become words joined by single blanks, and one overlapping regular
expression search gives, at each word, the spans of the runs of one, two and
three words that begin there; each span's crc32 is its bucket. Bucket counts of
the raw and of the target texts give every bucket a gain, a document's weight
is the sum of its features' gains, and adding seeded Gumbel noise to the
weights turns "the highest scores" into a draw without replacement.

Texts are searched once: the buckets of every document are stored as 16-bit
integers, and counting and weighing read those. Counts are summed in each task
and then by bucket, so that only ``BUCKETS`` rows are shuffled from a task and
reach the driver, whatever the corpus holds. Ranks come from a range partition
by score; no task sees more than its range.

Defined cases: a null or empty text has no features, weight 0 and too few words
to be drawn. Null doc_ids draw their noise from the empty id. Rows of one
doc_id, and repeated rows, are documents of their own (with the same noise);
ties in score go to the smaller doc_id (null first), then to fewer features.
Only the named columns are read, whatever else there is. An empty target has
counts of zero; an empty table gives no rows. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitnet.llm.common import map_batches, stored, texts_of

BUCKETS = 10_000
MIN_WORDS = 20
#: Of the documents that have enough words, this percentage is drawn.
DRAWN_PERCENT = 5
SEED = 42

#: Bytes of words: ASCII letters in lower case, digits, and all that is beyond ASCII.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
#: At a word's begin: three words (or as many as are left), the first two of them, the first.
_RUNS = regex.compile(rb"(?<![^ ])((([^ ]++)(?: [^ ]++)?+)(?: [^ ]++)?+)(?![^ ])")
_SPANS = methodcaller("group", 3, 2, 1)

FEATURES = "doc_id long, n_words long, buckets binary"


def words_of(text: str) -> bytes:
    """The words of ``text`` in lower case (A-Z only), joined by single blanks."""
    return b" ".join(text.encode("utf-8").translate(_PLAIN).split())


def buckets_of(words: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of one to three words, in order of their begins."""
    n = words.count(b" ") + 1 if words else 0
    found = chain.from_iterable(map(_SPANS, _RUNS.finditer(words, overlapped=True)))
    crc = np.fromiter(map(zlib.crc32, found), np.uint32, 3 * n)
    real = np.ones(3 * n, bool)
    real[3 * n - 2 :] = False  # at the last word there is no run of two or three,
    real[max(3 * n - 4, 0) : 3 * n - 3] = False  # at the one before none of three
    return crc[real] % buckets


def _features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            words = [words_of(t) for t in texts_of(batch)]
            yield {
                "doc_id": batch.column("doc_id"),
                "n_words": [w.count(b" ") + 1 if w else 0 for w in words],
                "buckets": [buckets_of(w, buckets).astype("<u2").tobytes() for w in words],
            }

    return run


def features(df: DataFrame, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, buckets)``: each document's features as little-endian unsigned 16-bit buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are stored in 16 bits")
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_batches(own, _features(buckets), FEATURES)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(raw, "<u2"), minlength=buckets)
        held = np.flatnonzero(total)
        yield {"bucket": held, "n": total[held]}

    return run


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has; at most ``buckets`` rows reach the driver."""
    found = map_batches(featured.select("buckets"), _counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in found.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) per bucket, in doubles."""
    all_raw, all_target = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    ratio = lambda s, t: ((t + 1.0) * all_raw) / ((s + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor of 1000 times a Gumbel variate that the seed and the id determine."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            raw, ids = batch.column("buckets").to_pylist(), batch.column("doc_id").to_pylist()
            weight = [int(gain[np.frombuffer(x, "<u2")].sum()) for x in raw]
            yield {
                "doc_id": batch.column("doc_id"),
                "n_words": batch.column("n_words"),
                "n_features": [len(x) // 2 for x in raw],
                "weight": weight,
                "score": [w + noise(i, seed) for w, i in zip(weight, ids)],
            }

    return run


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Ranks 1, 2, 3... of the drawn among ``scored``, null for the others."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = stored(placed, "resampled-order")  # places and the counts below must be of one run
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    n = placed.count()
    rank = F.col("_before") + F.col("_place") - F.shiftleft(F.col("_part").cast("long"), 33) + 1
    drawn = F.when(rank <= percent * n // 100, rank)
    return placed.join(F.broadcast(before), "_part").withColumn("rank", drawn)


def resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = DRAWN_PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    target_id: str = "item_id",
    target_text: str = "text",
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document of ``df``; rank is null for those not drawn.

    Drawn are ``percent`` of the documents with at least ``min_words`` words.
    """
    held = stored(features(df, buckets, doc_id, text), "resampled-features")
    goal = features(target, buckets, target_id, target_text)
    gain = gains(bucket_counts(held, buckets), bucket_counts(goal, buckets))
    columns = "doc_id long, n_words long, n_features long, weight long, score long"
    scored = stored(map_batches(held, _weigh(gain, seed), columns), "resampled-scores")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    ranked = _ranked(scored.where(F.col("n_words") >= min_words), percent).select(*names)
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others.select(*names))
