"""Session helpers: a local session for tests/bench and the checkpoint folder.

On a cluster the session comes from the caller; nothing here overrides its
settings except filling in a checkpoint folder when none is configured.
"""

from __future__ import annotations

import gc
import math
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "habitnet") -> SparkSession:
    """A local session with the settings the library assumes (AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.ansi.enabled", "true")
        # loop rounds write checkpoints; drop each one once nothing refers to it
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). Where
    neither is set, a local master, whose driver and executors are one process,
    gets a private temporary folder; any other master raises, as no local
    folder is shared by its executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="habitnet-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder and cut its lineage.

    Reliable (not local) checkpoints survive executor loss: the data lives in
    the shared folder, not in executor block managers.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_compact(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for a large frame of few columns: compressed Parquet in the shared folder.

    A checkpoint holds whole rows of 8 bytes a field and is several times as
    large, but keeps the partitioning, which this does not.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/compact-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of jobs that are over.

    Spark deletes a shuffle's files once the driver has collected the objects
    that stand for it, and an idle driver may not collect for half an hour. A
    job of several stored steps would keep the files of all of them until then.
    """
    for _ in range(2):  # Python lets go of its handles first, a moment later the driver of what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for a small frame that a loop carries from round to round.

    A checkpoint keeps the optimiser's size estimate, which for joins is a
    product: over rounds its digits multiply until the driver's memory ends.
    What is cached has its measured size instead, and the checkpoint keeps that.
    """
    held = df.persist()
    held.count()
    out = cut_lineage(held)
    held.unpersist()
    return out


ROWS_PER_PARTITION = 200_000


def partition_count(spark: SparkSession, rows: int, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    """Partitions for an explicit repartition of ``rows`` rows.

    At least the cluster's default parallelism (so every core gets work) and
    otherwise about ``rows_per_partition`` rows each, however many that makes.
    Explicit counts are used where the partitioning is cached and reused across
    loop steps, which AQE cannot coalesce afterwards.
    """
    floor = max(1, spark.sparkContext.defaultParallelism)
    return max(floor, math.ceil(max(rows, 1) / rows_per_partition))
