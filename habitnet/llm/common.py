"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from habitnet.session import checkpoint_dir, free_shuffles  # noqa: F401

LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text``, as UTF-8.

    ``bytes.split`` separates at exactly those six characters.
    """
    return text.encode("utf-8", "surrogatepass").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def struct_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """``mapInArrow`` for functions that yield columns as ``{name: values}``."""
    schema = struct_of(ddl)
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            arrays = [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; null reads as the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


#: Rows of one Arrow batch: whole texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have at most ``BATCH_ROWS`` rows (fewer if it says so already)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def worker_memo() -> dict:
    """One dictionary per Python worker process, kept between its tasks."""
    return sys.modules.setdefault("_llm_worker_memo", types.ModuleType("_llm_worker_memo")).__dict__


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there.

    It cuts the lineage as a checkpoint does, but in compressed columns; what
    is read from the files outlives any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
