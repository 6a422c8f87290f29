"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and
works on all documents that the one before it kept. All but the last return the
columns of ``documents``. ``run`` writes each stage's result as Parquet to the
shared checkpoint folder and reads it again for the next.

Defined cases: a null text is an empty one, which the quality rules reject; an
empty table goes through all stages and gives no rows; null doc_ids are kept as
documents of their own; repeated rows are copies, of which one stays; ties among
copies go to the least doc_id; texts are read whole at every stage; columns
beyond those of ``documents`` keep their values whatever their names, ``n_chars``
follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.llm import decontaminate, line_dedup, quality_rules, simhash
from habitnet.llm.common import small_batches, stored, table
from habitnet.llm.queries import packed_pieces


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that lose too much or fail the base rules."""
    small_batches(spark)
    return _sized(quality_rules.clean(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier one matches go, and documents that lose all their words."""
    return _sized(line_dedup.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a segment of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2,048 ids."""
    return packed_pieces(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("packing", pack),
]

#: SQL can't express the fingerprints' hash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
