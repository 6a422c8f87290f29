"""Registered queries that go through files: rendered logs and lists are written to the shared folder as the
source's numbered parts and text forms, and read back by the readers (S1..S9, S14, S15)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.operators import components as cc
from habitnet.operators import contacts as ct
from habitnet.operators import usage as us
from habitnet.plans import jobs
from habitnet.plans import queries as qs
from habitnet.session import checkpoint_dir
from habitnet.sources import codecs, logs
from habitnet.sources import tables as tb

#: The source's numbers of log parts, by kind of log.
LOG_PARTS = {"other": 64, "web": 4}
#: Which lines make up which log here.
LOG_STATUS = {"other": "O", "web": "F"}


def _folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _write_logs(spark: SparkSession, sf_dir: str, base: str) -> None:
    """Every order line as a web-log line, in the two logs' numbered parts."""
    for kind, parts in LOG_PARTS.items():
        lines = qs.web_log_lines(tb.order_lines(spark, sf_dir, F.col("l_linestatus") == LOG_STATUS[kind]))
        codecs.write_text(lines, f"{base}/{kind}", parts)


def usage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1..S4, M7, A2: both logs read by glob, matched through a dictionary read from CSV, counted and united."""
    base = _folder(spark, "usage-files")
    _write_logs(spark, sf_dir, base)
    qs.host_dictionary(spark, sf_dir).write.csv(f"{base}/dictionary")
    dictionary = logs.read_host_app(spark, f"{base}/dictionary")
    own = [us.format_usage(logs.read_web_log(spark, [f"{base}/{kind}/part-*"]), dictionary, before=qs.DAY_BOUND) for kind in LOG_PARTS]
    return us.union_usage(*own)


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per log the number of its files, from the files' names, and of its lines."""
    base = _folder(spark, "log-files")
    _write_logs(spark, sf_dir, base)
    read = [
        spark.read.text(f"{base}/{kind}/part-*").select(F.lit(kind).alias("log"), F.col("_metadata.file_name").alias("file")) for kind in LOG_PARTS
    ]
    both = read[0].unionByName(read[1])
    return both.groupBy("log").agg(F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_lines"))


def built_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage stored by the first of two calls; the second one, with other rows to build from, reads it."""
    path = f"{_folder(spark, 'built-once')}/usage"
    first = codecs.materialize(spark, path, lambda: us.count_usage(tb.usage_log(spark, sf_dir)))
    second = codecs.materialize(spark, path, lambda: first.limit(0))
    return second.groupBy("user").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cnt").alias("n_lines"))


def contact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call and message logs and the list of valid users as files, read into the contact graph."""
    base = _folder(spark, "contact-files")
    codecs.write_text(qs.voice_log_lines(spark, sf_dir), f"{base}/voice", LOG_PARTS["web"])
    codecs.write_text(qs.sms_log_lines(spark, sf_dir), f"{base}/sms", LOG_PARTS["web"])
    codecs.write_text(tb.valid_users(spark, sf_dir).select(F.col("user").alias("value")), f"{base}/valid", 1)
    valid = logs.read_id_list(spark, f"{base}/valid")
    voice, sms = logs.read_voice_log(spark, f"{base}/voice/part-*"), logs.read_sms_log(spark, f"{base}/sms/part-*")
    return ct.contact_graph(ct.voice_graph(voice, valid, qs.CONTACT_MIN_SEC), ct.mutual_sms_graph(sms, valid))


def edge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact graph as edge lines and its largest component's nodes as an id list, read into the subgraph."""
    base = _folder(spark, "edge-files")
    qs.contact_graph(spark, sf_dir).write.csv(f"{base}/edges")
    edges = logs.read_edge_list(spark, f"{base}/edges/part-*")
    largest = cc.largest_component(cc.connected_components(edges))
    codecs.write_text(largest.select(F.col("node").alias("value")), f"{base}/nodes", LOG_PARTS["web"])
    return cc.induced_subgraph(edges, logs.read_id_list(spark, f"{base}/nodes", "node"))


def exposure_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure rows of the train and of the test days, stored by part and read back."""
    state, cal, graph = qs._events_model(spark, sf_dir)
    stored = jobs.exposure_job(spark, _folder(spark, "exposure"), state, graph, cal, qs.EVENTS_TRAIN_UNTIL, qs.EVENTS_TEST_FROM)
    return qs.rows_with_neighbours(stored["rows"], stored["links"], ["part"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "usage_files": usage_files,
    "log_files": log_files,
    "built_once": built_once,
    "contact_files": contact_files,
    "edge_files": edge_files,
    "exposure_parts": exposure_parts,
}
