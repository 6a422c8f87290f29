"""Domain inputs derived from the driver's parquet tables.

The original jobs read web, call and SMS logs. The test tables carry the same
shapes under other names; these functions state the mapping once:

* usage log:   user = ``o_custkey``, app = ``l_partkey``, day = ``o_orderdate``
  (orders joined to lineitem; one log row per line item)
* day state:   user = ``user_id``, app = ``event_type``, day = day of ``ts``
  (``events``)
* contacts:    src = ``'c' || o_custkey``, dst = ``'s' || l_suppkey``,
  duration = ``l_quantity`` seconds, SMS flag = ``l_linestatus``
* valid users: customers and suppliers with a non-negative account balance

Only the columns used are selected, so the parquet scans prune the rest and
filters are pushed into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.session import partition_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, line_filter=None) -> DataFrame:
    """Line items with their order's customer and time: the raw usage/contact log.

    Both sides are large at scale: this is a shuffled join on the order key. Its
    number of partitions follows the lines: what is summed up right above the
    join, in the same tasks, would else need memory that grows with the input.
    """
    li = table(spark, sf_dir, "lineitem")
    parts = partition_count(spark, li.count())  # the files' footers tell
    if line_filter is not None:
        li = li.where(line_filter)
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag", "l_linenumber")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li, od = li.repartition(parts, "l_orderkey"), od.repartition(parts, "o_orderkey")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").drop("o_orderkey")


def usage_log(spark: SparkSession, sf_dir: str, line_filter=None) -> DataFrame:
    """(user, day, app) rows, one per line item."""
    return order_lines(spark, sf_dir, line_filter).select(
        F.col("o_custkey").alias("user"),
        F.to_date("o_orderdate").alias("day"),
        F.col("l_partkey").alias("app"),
    )


def events_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, app, day) from ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("user"),
        F.col("event_type").alias("app"),
        F.to_date("ts").alias("day"),
    ).distinct()


def ring_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour graph on ``events`` users: u -- u+1 when both exist, both directions.

    An equi-join of the distinct user list with itself shifted by one, so it
    stays a linear-size shuffle join at any scale.
    """
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    nxt = users.select((F.col("u") - 1).alias("u"), F.col("u").alias("v"))
    fwd = users.join(nxt, "u").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return fwd.unionByName(fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def contact_records(spark: SparkSession, sf_dir: str, line_filter=None) -> DataFrame:
    """(sec, src, dst, dur ms, flag) contact records from order lines."""
    ol = order_lines(spark, sf_dir, line_filter)
    return ol.select(
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("bigint").alias("sec"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("dur"),
        F.col("l_linestatus").alias("flag"),
    )


def valid_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("user")
    )
    supp = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") >= 0).select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("user")
    )
    return cust.unionByName(supp)
