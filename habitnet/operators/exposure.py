"""Day calendar, retention labels and neighbour-exposure rows.

An exposure row is one (user i, app j, day t) on which i used j and t has a
successor day: ``m0 = 1``; ``m1`` = i used j on the next day; and for every
neighbour l of i (restricted to users of the same split) ``ml0`` = l used j on
day t. The long "terms" form (one row per neighbour) is what the model
consumes; the nested ``ni`` array is an output format only, so no operator
needs a hub's whole neighbour list in one row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitnet.functions.seeded import md5_key
from habitnet.operators.joins import semi_join
from habitnet.operators.usage import popular_apps
from habitnet.session import cut_lineage, partition_count


def calendar(days: DataFrame, day: str = "day", max_gap: int = 1, bridges: DataFrame | None = None,
             terminals: Iterable[str] | None = None) -> DataFrame:
    """(day, next_day) for every distinct day.

    ``next_day`` is the earliest present day within ``max_gap`` days after
    ``day``, else null (a terminal day). Explicit ``bridges`` rows
    (day, next_day) override, and listed ``terminals`` are forced to null.
    Computed with an equi-join on ``day + g`` (g = 1..max_gap), so no
    window over the whole calendar runs in one task.
    """
    d = days.select(F.col(day).cast("date").alias("day")).where(F.col("day").isNotNull()).distinct()
    cand = d.select("day", F.explode(F.sequence(F.lit(1), F.lit(int(max_gap)))).alias("_g")).select(
        "day", F.date_add("day", F.col("_g")).alias("_nd")
    )
    found = cand.join(d.select(F.col("day").alias("_nd")), "_nd").groupBy("day").agg(F.min("_nd").alias("next_day"))
    cal = d.join(found, "day", "left")
    if bridges is not None:
        b = bridges.select(F.col("day").cast("date").alias("day"), F.col("next_day").cast("date").alias("_bn"))
        cal = cal.join(b, "day", "left").select("day", F.coalesce("_bn", "next_day").alias("next_day"))
    if terminals:
        t = [F.lit(x).cast("date") for x in terminals]
        cal = cal.withColumn("next_day", F.when(F.col("day").isin(*t), F.lit(None).cast("date")).otherwise(F.col("next_day")))
    return cal


def retention_labels(state: DataFrame, cal: DataFrame) -> DataFrame:
    """(user, app, day, next_day, m1) for rows whose day has a successor;
    m1 = 1 when the same (user, app) occurs on next_day."""
    s = state.select("user", "app", "day").distinct()
    rows = s.join(F.broadcast(cal.where(F.col("next_day").isNotNull())), "day")  # calendar: one row per day
    nxt = s.select(F.col("user"), F.col("app"), F.col("day").alias("next_day"), F.lit(1).alias("m1"))
    return rows.join(nxt, ["user", "app", "next_day"], "left").select(
        "user", "app", "day", "next_day", F.coalesce("m1", F.lit(0)).alias("m1")
    )


DAY_BITS = 62  # days of one word of a bitmap
LINKS_PER_PARTITION = 1_000_000


def _numbered_days(cal: DataFrame) -> DataFrame:
    """(day, d, next_d): the calendar's days and their next days numbered in order. One row per day, as the calendar."""
    days = cal.select("day").unionByName(cal.select(F.col("next_day").alias("day"))).where(F.col("day").isNotNull()).distinct()
    numbered = days.withColumn("d", F.row_number().over(Window.orderBy("day")) - 1)
    nxt = numbered.select(F.col("day").alias("next_day"), F.col("d").alias("next_d"))
    return cut_lineage(numbered.join(cal, "day", "left").join(nxt, "next_day", "left").select("day", "d", "next_d"))


def day_bitmaps(state: DataFrame, days: DataFrame, where: Column | None = None) -> DataFrame:
    """(user, app, bits map<word, bits>): one row per pair for all its days; ``bit_or`` combines map-side."""
    on = state.select("user", "app", "day").join(F.broadcast(days if where is None else days.where(where)), "day")  # one row per day
    words = on.groupBy("user", "app", F.floor(F.col("d") / DAY_BITS).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("d") % DAY_BITS)).alias("b")
    )
    return words.groupBy("user", "app").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("bits"))


def _has_day(bits: Column, d: Column) -> Column:
    """1 if the day numbered ``d`` is set, else 0 (also for a null map or day)."""
    word = F.try_element_at(bits, F.floor(d / DAY_BITS).cast("int"))
    return F.coalesce(F.call_function("shiftright", word, (d % DAY_BITS).cast("int")).bitwiseAND(1).cast("int"), F.lit(0))


def _set_days(bits: Column) -> Column:
    """The numbers of the days set."""
    of_word = lambda e: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(DAY_BITS - 1)), lambda i: F.call_function("shiftright", e["value"], i).bitwiseAND(1) == 1),
        lambda i: i + e["key"] * DAY_BITS,
    )
    return F.flatten(F.transform(F.map_entries(bits), of_word))


def _links(own: DataFrame, nb: DataFrame) -> int:
    """How many rows ``own`` has after its days are rows, once for each neighbour."""
    days = F.aggregate(F.map_values("bits"), F.lit(0).cast("long"), lambda n, word: n + F.bit_count(word))
    per_user = own.groupBy(F.col("user").alias("i")).agg(F.sum(days).alias("days"))
    return nb.join(per_user, "i").agg(F.sum("days")).first()[0] or 0


def _linked_pairs(split: DataFrame, state: DataFrame, graph: DataFrame, cal: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pairs`` (i, j, _used, bits), ``links`` (i, j, l, _used, bits) and the numbered days, as maps still.

    Both frames are dealt by (i, j) to as many partitions as the links' days need: AQE would merge the few
    bytes of the maps to one task. What is grouped by (i, j, t) later on stays where it is.
    Maps, users and neighbour pairs are checkpointed, so that AQE can split a
    hub's or a hot user's partition in each join.
    """
    days = _numbered_days(cal)
    used = cut_lineage(day_bitmaps(state, days))
    own = cut_lineage(day_bitmaps(split, days, F.col("next_d").isNotNull()))
    nb = graph.select(F.col("src").alias("i"), F.col("dst").alias("l")).distinct()
    nb = cut_lineage(semi_join(nb, own, "l", "user"))
    parts = partition_count(split.sparkSession, _links(own, nb), LINKS_PER_PARTITION)
    pairs = own.join(used.withColumnRenamed("bits", "_used"), ["user", "app"], "left")
    pairs = pairs.select(F.col("user").alias("i"), F.col("app").alias("j"), "_used", "bits").repartition(parts, "i", "j")
    links = (
        own.select(F.col("user").alias("i"), F.col("app").alias("j"), "bits")
        .join(nb, "i")
        .join(used.select(F.col("user").alias("l"), F.col("app").alias("j"), F.col("bits").alias("_used")), ["l", "j"], "left")
        .select("i", "j", "l", "_used", "bits")
        .repartition(parts, "i", "j")
    )
    return pairs, links, F.broadcast(days.select(F.col("day").alias("t"), "d", "next_d"))  # one row per day


def exposure_long(split: DataFrame, state: DataFrame, graph: DataFrame, cal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M18 in long form.

    Returns ``rows`` (i, j, t, m0, m1) and ``links`` (i, j, t, l, ml0), where
    ``split`` holds the (user, app, day) rows of one part (train or test),
    ``state`` every (user, app, day) used (lookups for m1 and ml0), ``graph``
    directed (src, dst) neighbour edges and ``cal`` the calendar.
    Neighbours are limited to users of the split with a non-terminal day.

    Days are bits of a map per (user, app), so the joins carry one row per pair
    and neighbour, whatever the number of days: m1 is the bit of the next day,
    ml0 that of the day itself, and days become rows after the last shuffle only.
    """
    pairs, links, by_day = _linked_pairs(split, state, graph, cal)
    rows = pairs.select("i", "j", "_used", F.explode(_set_days(F.col("bits"))).alias("d")).join(by_day, "d")
    rows = rows.select("i", "j", "t", F.lit(1).alias("m0"), _has_day(F.col("_used"), F.col("next_d")).alias("m1"))
    links = links.select("i", "j", "l", "_used", F.explode(_set_days(F.col("bits"))).alias("d")).join(by_day, "d")
    return rows, links.select("i", "j", "t", "l", _has_day(F.col("_used"), F.col("d")).alias("ml0"))


def exposure_rows(split: DataFrame, state: DataFrame, graph: DataFrame, cal: DataFrame) -> DataFrame:
    """M18 nested: (i, j, t, m0, m1, ni array<struct<l, ml0>>) sorted by l.

    Builds one array per row; meant for export (S13) and inspection, while the
    model reads :func:`exposure_long`. A pair's neighbours are collected and sorted
    once, with their days as maps, not once for each of its days.
    """
    pairs, links, by_day = _linked_pairs(split, state, graph, cal)
    none = F.array().cast("array<struct<w:int,b:bigint>>")
    words = F.transform(F.map_entries("_used"), lambda e: F.struct(e["key"].alias("w"), e["value"].alias("b")))
    nbs = links.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("l", F.coalesce(words, none).alias("words")))).alias("nbs"))
    both = pairs.join(nbs, ["i", "j"], "left").select("i", "j", "_used", "nbs", F.explode(_set_days(F.col("bits"))).alias("d")).join(by_day, "d")
    word = F.floor(F.col("d") / DAY_BITS).cast("int")

    def on_day(x: Column) -> Column:
        of_word = F.aggregate(x["words"], F.lit(0).cast("long"), lambda n, e: F.when(e["w"] == word, e["b"]).otherwise(n))
        return F.call_function("shiftright", of_word, (F.col("d") % DAY_BITS).cast("int")).bitwiseAND(1).cast("int")

    ni = F.transform("nbs", lambda x: F.struct(x["l"].alias("l"), on_day(x).alias("ml0")))
    kind = f"array<struct<l:{nbs.schema['nbs'].dataType.elementType['l'].dataType.simpleString()},ml0:int>>"
    return both.select("i", "j", "t", F.lit(1).alias("m0"), _has_day(F.col("_used"), F.col("next_d")).alias("m1"), F.coalesce(ni, F.array().cast(kind)).alias("ni"))


def model_usage(usage: DataFrame, users: DataFrame | None = None, min_users: int = 10) -> DataFrame:
    """The usage the exposure model runs on: users of the index (J3/P10), apps
    with at least ``min_users`` distinct users among them (P8, inclusive)."""
    u = usage.select("user", "app", "day")
    if users is not None:
        u = semi_join(u, users, "user")
    return semi_join(u, popular_apps(u, min_users), "app")


def holdout_days(days: DataFrame, folds: int, train_share: float = 0.8, seed: int = 42, day: str = "day") -> DataFrame:
    """Repeated day hold-out. For each fold f, days are ordered by
    md5(day # f # seed); the first floor(train_share * n) are train, the rest valid.

    The per-fold window holds one row per calendar day (a few thousand at
    most), replicated ``folds`` times.
    """
    d = days.select(F.col(day).cast("date").alias("day")).distinct()
    df = d.select("day", F.explode(F.sequence(F.lit(0), F.lit(int(folds) - 1))).alias("fold"))
    n = F.count(F.lit(1)).over(Window.partitionBy("fold"))
    rk = F.row_number().over(Window.partitionBy("fold").orderBy(md5_key(F.col("day"), F.col("fold"), F.lit(seed)), F.col("day")))
    return df.select("fold", "day", (rk <= F.floor(n * F.lit(float(train_share)))).alias("is_train"))
