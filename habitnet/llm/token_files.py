"""Token ids in Parquet files made for selective reads.

Documents are range-partitioned and sorted by id, encoded, and written by
Spark's Parquet writer: one list column of ids (dictionary-encoded, as a
vocabulary is far smaller than a row group) beside narrow columns that the
version-2 writer stores as deltas. Row groups and pages are small and carry
column indexes, so a read of one id range or of the metadata alone touches few
pages. File numbers follow the id order, hence a document's place in the whole
stream is its place in its file plus the lengths of the files before.

Defined cases: a null text is the empty text (its end id only); null doc_ids
come first; rows of one doc_id are ordered by a hash of their texts and each
gets its own place; an empty table gives an empty folder that reads as no rows.
Texts are encoded whole, one at a time. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitnet.llm.common import map_batches, texts_of
from habitnet.llm.encode import encoder

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 500
#: Documents encoded at a time.
ROWS_AT_ONCE = 256

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
}
FILE_SCHEMA = "doc_id long, first_in_file long, n_tokens int, ids array<int>"


def by_id(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` in ranges of ascending id, sorted in each range.

    The hash of the text spreads and orders rows that share an id.
    """
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    return own.repartitionByRange(*order).sortWithinPartitions(*order)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc, first = encoder(path), 0
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids = [enc.encode(t) + end for t in texts_of(batch)]
                lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                flat = np.frombuffer(b"".join(ids), "<i4")
                yield {
                    "doc_id": batch.column("doc_id"),
                    "first_in_file": first + offsets[:-1],
                    "n_tokens": lengths.astype(np.int32),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                }
                first += int(offsets[-1])

    return run


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every document below ``path``."""
    encoded = map_batches(by_id(df, doc_id, text), _encode(tokenizer, end_id), FILE_SCHEMA)
    encoded.write.options(**WRITE_OPTIONS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with the name and the number of their file."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return rows.select("*", F.col("_metadata.file_name").alias("file"), number.alias("file_number"))


def file_starts(rows: DataFrame) -> DataFrame:
    """``(file, file_start)``: the ids in all files before. One row per file, two columns read."""
    lengths = rows.groupBy("file_number", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_number", "file").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        flat = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield {n: batch.column(n) for n in ("doc_id", "first_in_file", "n_tokens", "file")} | {"ids_crc32": crc}


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: its place in the whole stream, its length and the crc32 of its ids."""
    rows = read(spark, path)
    own = map_batches(
        rows.select("doc_id", "first_in_file", "n_tokens", "file", "ids"),
        _digests,
        "doc_id long, first_in_file long, n_tokens int, file string, ids_crc32 long",
    )
    return own.join(file_starts(rows), "file").select(
        "doc_id", (F.col("file_start") + F.col("first_in_file")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )
