"""Readers for the raw, positional, delimiter-separated logs (S1..S9).

Every reader is ``spark.read.text`` (one pass over any number of files, globs
or part lists) followed by a column-expression parser. Parsers are exposed on
their own so that a DataFrame holding a ``value`` line column can be parsed
without touching files. Bad numbers turn into nulls (``try_cast``) and such
rows are dropped, where the source job would have failed the whole task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.functions.text import field, split_fields, to_int

# Fixed field positions of the raw logs (0-based), as the source jobs use them.
WEB_FIELDS = {"sec": 0, "user": 1, "host": 4, "url": 10}
VOICE_FIELDS = {"sec": 0, "src": 1, "dst": 5, "dur": 8}
SMS_FIELDS = {"sec": 0, "src": 1, "dst": 5, "flag": 7}


def _paths(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def parse_web_log(lines: DataFrame, sep: str = "|") -> DataFrame:
    """``value`` lines -> (user, sec, host, url). Empty host/url become null."""
    parts = F.col("_parts")
    out = _split_once(lines, sep).select(
        field(parts, WEB_FIELDS["user"]).alias("user"),
        to_int(field(parts, WEB_FIELDS["sec"])).alias("sec"),
        F.nullif(field(parts, WEB_FIELDS["host"]), F.lit("")).alias("host"),
        F.nullif(field(parts, WEB_FIELDS["url"]), F.lit("")).alias("url"),
    )
    return out.where(F.col("user").isNotNull() & F.col("sec").isNotNull())


def _split_once(lines: DataFrame, sep: str) -> DataFrame:
    """The split array as its own column, computed once per line.

    The one-element ``inline`` is an optimizer barrier: the validity filter
    on the parsed fields cannot be pushed beneath a generator, so Catalyst
    does not copy the split (and whatever built the line) into the filter.
    """
    return lines.select(F.inline(F.array(F.struct(split_fields("value", sep).alias("_parts")))))


def read_web_log(spark: SparkSession, paths: str | Iterable[str], sep: str = "|") -> DataFrame:
    return parse_web_log(spark.read.text(_paths(paths)), sep)


def parse_voice_log(lines: DataFrame, sep: str = "|") -> DataFrame:
    """``value`` lines -> (sec, src, dst, dur) with ``dur`` in milliseconds."""
    parts = F.col("_parts")
    out = _split_once(lines, sep).select(
        to_int(field(parts, VOICE_FIELDS["sec"])).alias("sec"),
        field(parts, VOICE_FIELDS["src"]).alias("src"),
        field(parts, VOICE_FIELDS["dst"]).alias("dst"),
        to_int(field(parts, VOICE_FIELDS["dur"])).alias("dur"),
    )
    return out.dropna(subset=["sec", "src", "dst", "dur"])


def read_voice_log(spark: SparkSession, paths: str | Iterable[str], sep: str = "|") -> DataFrame:
    return parse_voice_log(spark.read.text(_paths(paths)), sep)


def parse_sms_log(lines: DataFrame, sep: str = "|") -> DataFrame:
    """``value`` lines -> (sec, src, dst, flag); ``flag`` tells sent from received."""
    parts = F.col("_parts")
    out = _split_once(lines, sep).select(
        to_int(field(parts, SMS_FIELDS["sec"])).alias("sec"),
        field(parts, SMS_FIELDS["src"]).alias("src"),
        field(parts, SMS_FIELDS["dst"]).alias("dst"),
        to_int(field(parts, SMS_FIELDS["flag"])).alias("flag"),
    )
    return out.dropna(subset=["sec", "src", "dst", "flag"])


def read_sms_log(spark: SparkSession, paths: str | Iterable[str], sep: str = "|") -> DataFrame:
    return parse_sms_log(spark.read.text(_paths(paths)), sep)


def read_id_list(spark: SparkSession, paths: str | Iterable[str], name: str = "user") -> DataFrame:
    """One id per line -> a single, distinct id column."""
    return (
        spark.read.text(_paths(paths))
        .select(F.trim("value").alias(name))
        .where(F.col(name) != "")
        .distinct()
    )


def read_edge_list(spark: SparkSession, paths: str | Iterable[str], sep: str = ",") -> DataFrame:
    """``src,dst`` per line."""
    return spark.read.csv(_paths(paths), schema="src string, dst string", sep=sep).dropna()


def read_host_app(spark: SparkSession, path: str | Iterable[str]) -> DataFrame:
    """CSV ``host,app`` dictionary; on a repeated key the later line wins.

    Lines are ordered by file path, then by the block's place in the file, then
    by their place in the block (Spark itself deals out files by size). The
    result has one row per key.
    """
    raw = spark.read.csv(_paths(path), schema="host string, app string").select(
        "host", "app", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_pos")
    ).dropna(subset=["host", "app"])
    return raw.groupBy("host").agg(F.max_by("app", "_pos").alias("app"))
