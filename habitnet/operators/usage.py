"""Usage table build and its filters (M7, M8; P1..P5, P8..P11; A1..A7, A14).

Usage schema: ``(user, day date, app, cnt bigint)``. All aggregations are
plain ``groupBy`` so Spark plans partial (map-side) aggregation before the
shuffle; hot users or apps only grow the partial aggregates, not one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from habitnet.functions.text import epoch_to_day
from habitnet.operators.joins import semi_join
from habitnet.session import cut_lineage


def match_apps(log: DataFrame, host_app: DataFrame, host: str = "host", url: str = "url") -> DataFrame:
    """App by host, else by url; rows matching neither are dropped.

    ``host_app`` has one row per key (see ``read_host_app``). It is checkpointed
    first, so that both sides of each join come from an exchange and AQE can
    split a hot host's partition. The log itself is read once and never stored:
    it passes both joins in turn. For the second one a line that its host matched
    has a key of its own that no url can equal, so these lines spread evenly
    instead of meeting under one null.
    """
    d = cut_lineage(host_app.select(F.col("host").alias("_key"), F.col("app").alias("_app")))
    seen = log.join(d, log[host] == d["_key"], "left").drop("_key").withColumnRenamed("_app", "_by_host")
    matched = F.col("_by_host").isNotNull()
    spread = F.xxhash64(*[c for c in log.columns if c != url]).cast("string")
    seen = seen.withColumns({"_key": F.when(matched | F.col(url).isNull(), spread).otherwise(F.col(url)), "_open": ~matched & F.col(url).isNotNull()})
    urls = d.select("_key", "_app", F.lit(True).alias("_open"))
    both = seen.join(urls, ["_key", "_open"], "left").withColumn("app", F.coalesce("_by_host", "_app"))
    return both.where(F.col("app").isNotNull()).select(*log.columns, "app")


def count_usage(rows: DataFrame, user: str = "user", day: str = "day", app: str = "app") -> DataFrame:
    """A1: number of log rows per (user, day, app)."""
    return rows.groupBy(F.col(user).alias("user"), F.col(day).alias("day"), F.col(app).alias("app")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def bound_days(df: DataFrame, before: _dt.date | str | None, day: str = "day") -> DataFrame:
    """P5: keep days strictly before ``before`` (no bound when None)."""
    if before is None:
        return df
    return df.where(F.col(day) < F.lit(before).cast("date"))


def format_usage(log: DataFrame, host_app: DataFrame, before: _dt.date | str | None = None) -> DataFrame:
    """M7 for one log source: parsed web log (user, sec, host, url) -> usage.

    Match the app (P2, P3), epoch seconds to day in the session zone (P4),
    upper day bound (P5), count by (user, day, app) (A1).
    """
    matched = match_apps(log, host_app)
    dayed = matched.select("user", epoch_to_day(F.col("sec")).alias("day"), "app")
    return count_usage(bound_days(dayed, before))


def union_usage(*usages: DataFrame) -> DataFrame:
    """A2/S3: sum counts over several usage sources."""
    allu = usages[0].select("user", "day", "app", "cnt")
    for u in usages[1:]:
        allu = allu.unionByName(u.select("user", "day", "app", "cnt"))
    return allu.groupBy("user", "day", "app").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def usage_stats(usage: DataFrame, approx: bool = False) -> DataFrame:
    """A3/A4/A14 in one job: rows, users, apps and mean distinct apps per user.

    ``approx=True`` counts users and apps with HyperLogLog++
    (``approx_count_distinct``), which needs no distinct shuffle."""
    pairs = usage.groupBy("user", "app").agg(F.count(F.lit(1)).alias("_rows"))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    out = pairs.agg(
        F.sum("_rows").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_pairs"),
        distinct("user").alias("n_users"),
        distinct("app").alias("n_apps"),
    )
    # mean of per-user distinct app counts = distinct pairs / users
    return out.withColumn("mean_apps_per_user", F.col("n_pairs") / F.col("n_users"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach a row counter to ``df`` without an extra job.

    The count is filled in by whatever action later runs ``df``
    (``obs.get["rows"]``), replacing the separate count jobs of a progress log.
    """
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def app_popularity(usage: DataFrame) -> DataFrame:
    """Distinct users per app."""
    return usage.select("user", "app").distinct().groupBy("app").agg(F.count(F.lit(1)).alias("n_users"))


def popular_apps(usage: DataFrame, min_users: int = 10) -> DataFrame:
    """Apps used by at least ``min_users`` distinct users (inclusive bound)."""
    return app_popularity(usage).where(F.col("n_users") >= min_users)


def involved_usage(usage: DataFrame, users: DataFrame | None = None, min_users: int = 10, user_col: str = "user") -> DataFrame:
    """M8: usage of the given users (P10), restricted to apps popular among
    them (P8); users left with no app disappear with their rows (P9)."""
    u = usage if users is None else semi_join(usage, users, "user", user_col)
    return semi_join(u, popular_apps(u, min_users), "app")  # the popular apps are stored, not the usage


def user_app_sets(usage: DataFrame) -> DataFrame:
    """(user, sorted distinct apps). Distinct first, so the collect
    only gathers one row per (user, app)."""
    return (
        usage.select("user", "app")
        .distinct()
        .groupBy("user")
        .agg(F.array_sort(F.collect_list("app")).alias("apps"), F.count(F.lit(1)).alias("n_apps"))
    )


def split_by_day(usage: DataFrame, train_until: str, test_from: str, day: str = "day") -> DataFrame:
    """Label rows 'train' (day <= train_until) or 'test' (day >= test_from);
    the gap between the two is dropped."""
    d = F.col(day)
    until, since = F.lit(train_until).cast("date"), F.lit(test_from).cast("date")
    # the bounds first, as plain comparisons: they reach the scan
    kept = usage.where((d <= until) | (d >= since))
    return kept.withColumn("part", F.when(d <= until, F.lit("train")).otherwise(F.lit("test")))
