"""Which labelled rows a classifier may learn from, and a bounded sample of their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT_FOLD = 2


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """``(label, text, part)`` of at most ``rows_per_class`` labelled documents of each class outside the held-out fold.

    The rows with the least hashes of their ids are taken. ``part`` is true for
    one in four, which calibrate what the others teach. The sample of ids is
    small by its bound (24 bytes a row), so it is broadcast; documents that
    share an id are cut to the bound again.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where((fold(F.col("doc_id")) != HELD_OUT_FOLD) & F.col("label").isin(0, 1))
    taken = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        for value in (0, 1)
    ]
    chosen = F.broadcast(taken[0].unionByName(taken[1]).dropDuplicates(["doc_id", "label"]))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) == 0
    return own.select("label", "text", part.alias("part")).limit(4 * rows_per_class)
