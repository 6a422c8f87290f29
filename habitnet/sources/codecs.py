"""Text forms of the intermediate tables (S10..S14) and build-once storage.

Parquet is the default storage; the text forms exist for exchange with the
line formats the original jobs wrote:

* app sets   ``user|a,b,c``
* factors    ``id,f0,...,f{d-1}``
* id index   ``user,idx``
* exposure   ``i,j,t,m0,m1,l#ml0|l#ml0...`` (empty tail when no neighbour)

All encoders and decoders are column expressions (``concat_ws``/``transform``
and ``split``/``transform``), so they run in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.functions.text import split_fields

# ---- S10 app sets ----------------------------------------------------------------------

def app_sets_to_text(df: DataFrame, user: str = "user", apps: str = "apps") -> DataFrame:
    return df.select(F.concat_ws("|", F.col(user).cast("string"), F.array_join(F.col(apps).cast("array<string>"), ",")).alias("value"))


def app_sets_from_text(lines: DataFrame) -> DataFrame:
    parts = split_fields("value", "|")
    return lines.select(
        F.try_element_at(parts, F.lit(1)).alias("user"),
        F.array_sort(F.array_distinct(F.split(F.try_element_at(parts, F.lit(2)), ","))).alias("apps"),
    )


# ---- S11 factors -----------------------------------------------------------------------

def factors_to_text(df: DataFrame, key: str = "id", factor: str = "factor") -> DataFrame:
    return df.select(
        F.concat_ws(",", F.col(key).cast("string"), F.array_join(F.transform(factor, lambda x: x.cast("string")), ",")).alias("value")
    )


def factors_from_text(lines: DataFrame, key: str = "id") -> DataFrame:
    parts = F.split(F.col("value"), ",")
    return lines.select(
        F.try_element_at(parts, F.lit(1)).alias(key),
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("factor"),
    )


# ---- S12 id index ----------------------------------------------------------------------

def index_to_text(df: DataFrame, key: str = "user", idx: str = "idx") -> DataFrame:
    return df.select(F.concat_ws(",", F.col(key).cast("string"), F.col(idx).cast("string")).alias("value"))


def index_from_text(lines: DataFrame, key: str = "user", idx: str = "idx") -> DataFrame:
    parts = F.split(F.col("value"), ",")
    return lines.select(F.try_element_at(parts, F.lit(1)).alias(key), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias(idx))


# ---- S13 exposure rows -----------------------------------------------------------------

def exposure_to_text(df: DataFrame) -> DataFrame:
    """(i, j, t date, m0, m1, ni array<struct<l, ml0>>) -> one line each.

    Neighbours are written in ascending ``l`` so the text is deterministic.
    """
    head = F.concat_ws(
        ",",
        F.col("i").cast("string"),
        F.col("j").cast("string"),
        F.date_format("t", "yyyyMMdd"),
        F.col("m0").cast("string"),
        F.col("m1").cast("string"),
    )
    tail = F.array_join(
        F.transform(F.array_sort("ni"), lambda s: F.concat_ws("#", s["l"].cast("string"), s["ml0"].cast("string"))),
        "|",
    )
    return df.select(F.concat(head, F.lit(","), tail).alias("value"))


def exposure_from_text(lines: DataFrame, id_type: str = "bigint", app_type: str = "bigint") -> DataFrame:
    """Inverse of :func:`exposure_to_text`. An empty tail gives an empty ``ni``
    (Spark's ``split`` keeps the trailing empty string, so it is filtered)."""
    parts = F.split(F.col("value"), ",", 6)
    tail = F.try_element_at(parts, F.lit(6))
    pairs = F.filter(F.split(F.coalesce(tail, F.lit("")), r"\|"), lambda x: x != "")
    ni = F.transform(
        pairs,
        lambda x: F.struct(
            F.split(x, "#").getItem(0).try_cast(id_type).alias("l"),
            F.split(x, "#").getItem(1).try_cast("int").alias("ml0"),
        ),
    )
    return lines.select(
        F.try_element_at(parts, F.lit(1)).try_cast(id_type).alias("i"),
        F.try_element_at(parts, F.lit(2)).try_cast(app_type).alias("j"),
        F.try_to_timestamp(F.try_element_at(parts, F.lit(3)), F.lit("yyyyMMdd")).cast("date").alias("t"),
        F.try_element_at(parts, F.lit(4)).try_cast("int").alias("m0"),
        F.try_element_at(parts, F.lit(5)).try_cast("int").alias("m1"),
        ni.alias("ni"),
    )


# ---- S14 / S15 ------------------------------------------------------------------------

def write_text(df: DataFrame, path: str, num_files: int, mode: str = "errorifexists") -> None:
    """A one-column ``value`` frame written as exactly ``num_files`` text files."""
    df.select("value").repartition(num_files).write.mode(mode).text(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the session (any scheme)."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(hconf).exists(p))


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet", parts: str | None = None) -> DataFrame:
    """Build once, reuse afterwards; in folders by the column ``parts``, if given.

    A folder is finished once it holds the ``_SUCCESS`` file that the job commit
    writes last; then it is read. A folder without it is what a job left that
    died, and is built again. Otherwise ``build()`` is written there
    (``errorifexists``: two racing writers fail loudly instead of mixing files)
    and read back, so the caller always gets a lineage-free scan.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        writer = build().write.format(fmt).mode("overwrite" if path_exists(spark, path) else "errorifexists")
        (writer.partitionBy(parts) if parts else writer).save(path)
    return spark.read.format(fmt).load(path)
