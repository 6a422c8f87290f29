"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the driver tables.

Every query reads whole tables (no id subsets, no row caps); the fixed
parameters below pick shapes on which the operator does real work (see
README, "Query set"). Float outputs are rounded at the very end so that the
DuckDB oracle, which sums in another order, hashes the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.operators import components as cc
from habitnet.operators import contacts as ct
from habitnet.operators import exposure as ex
from habitnet.operators import factors as fa
from habitnet.operators import joins
from habitnet.operators import model as md
from habitnet.functions import vectors as vx
from habitnet.operators import knn
from habitnet.operators import usage as us
from habitnet.session import cut_compact, cut_lineage
from habitnet.sources import tables as tb
from habitnet.functions.text import day_text_to_date, epoch_to_day_text
from habitnet.sources.codecs import (
    app_sets_from_text,
    app_sets_to_text,
    exposure_from_text,
    exposure_to_text,
    factors_from_text,
    factors_to_text,
    index_from_text,
    index_to_text,
)
from habitnet.sources.logs import parse_sms_log, parse_voice_log, parse_web_log

# ---- fixed query parameters --------------------------------------------------------------
DAY_BOUND = "1998-01-01"          # P5 upper bound (exclusive)
TRAIN_UNTIL = "1997-06-30"        # P11 train part: day <= this
TEST_FROM = "1997-08-01"          # P11 test part: day >= this
POPULAR_MIN_USERS = 30            # P8 bound for the popularity queries
CONTACT_MIN_SEC = 50              # M1 duration bound (l_quantity seconds)
CONTACT_SECS = (15, 20, 25, 30)    # the source's duration bounds
KNN_K = 10                        # neighbours per user (the combined graph uses 10)
SPARSE_K = 10                     # order-day usage: users with few positive neighbours
CALENDAR_MAX_GAP = 2              # order days: bridge one missing day
MODEL_MIN_USERS = 10              # P8 bound of the exposure model (inclusive)
EVENTS_TRAIN_UNTIL = "2024-01-20"  # P11 on the events: train days up to this,
EVENTS_TEST_FROM = "2024-01-24"    # test days from this
HOLDOUT_FOLDS = 3
HOLDOUT_SEED = 42
LMF_RANK = 5                      # factor model rank of the similarity job
LMF_RATE = 1e-4
LMF_SEED = 42
LMF_STEPS = 800                   # steps/restarts of the source
LMF_RESTARTS = 6
LMF_TRAIN_STEPS = 4               # steps/restarts of the run that ``improved_knn_graph`` takes
LMF_TRAIN_RESTARTS = 2
MODEL_RANK = 7                    # exposure model rank
MODEL_SEED = 42
MODEL_GD_RATE = 0.5
CV_FOLDS = 10                     # the source's cross-validation
CV_EPOCHS = 21
SWEEP_RANKS = (1, 2)


def _usage(spark, sf_dir, line_filter=None) -> DataFrame:
    return us.count_usage(tb.usage_log(spark, sf_dir, line_filter))


# ---- usage -----------------------------------------------------------------------------

def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


def web_log_lines(ol: DataFrame) -> DataFrame:
    """Order lines as 11-field '|' web-log lines."""
    host = F.concat(F.lit("h"), F.col("l_partkey").cast("string"), F.lit(".example.com"))
    url = F.concat(F.lit("http://u"), F.col("l_partkey").cast("string"), F.lit(".example.org/"))
    sec = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("l_linenumber") * 3600
    filler = F.lit("-")
    line = F.concat_ws("|", sec.cast("string"), F.col("o_custkey").cast("string"), filler, filler, host, filler, filler, filler, filler, filler, url)
    return ol.select(line.alias("value"))


def host_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, app) from ``part``: host entries for small parts, url entries for these and mid-size ones."""
    part = tb.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    by_host = part.where(F.col("p_size") <= 25).select(
        F.concat(F.lit("h"), F.col("p_partkey").cast("string"), F.lit(".example.com")).alias("host"),
        F.col("p_partkey").cast("string").alias("app"),
    )
    by_url = part.where(F.col("p_size") <= 45).select(
        F.concat(F.lit("http://u"), F.col("p_partkey").cast("string"), F.lit(".example.org/")).alias("host"),
        F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("app"),
    )
    return by_host.unionByName(by_url)


def usage_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole M7 text path: order lines rendered as web-log lines, parsed
    back (S1/P1/F14/F15), matched to apps through a host/url dictionary built
    from ``part`` (larger parts unmatched), day (P4), bound (P5), counted (A1)."""
    log = parse_web_log(web_log_lines(tb.order_lines(spark, sf_dir)))
    return us.format_usage(log, host_dictionary(spark, sf_dir), before=DAY_BOUND)


def usage_union_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = _usage(spark, sf_dir, F.col("l_linestatus") == "O")
    closed = _usage(spark, sf_dir, F.col("l_linestatus") == "F")
    return us.union_usage(open_, closed)


def host_app_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tb.table(spark, sf_dir, "pages").select("page_id", "url")
    log = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"), "url")
    hosts = log.select("host").distinct()
    by_host = hosts.where(F.col("host").endswith(".example.com")).select("host", F.concat(F.lit("app:"), F.col("host")).alias("app"))
    by_url = log.where(F.col("host").endswith(".example.net")).select(
        F.col("url").alias("host"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("app")
    )
    return us.match_apps(log, by_host.unionByName(by_url)).select("page_id", "host", "app")


def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = us.usage_stats(_usage(spark, sf_dir))
    return s.select("n_rows", "n_pairs", "n_users", "n_apps", F.round("mean_apps_per_user", 6).alias("mean_apps_per_user"))


def usage_date_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.bound_days(_usage(spark, sf_dir), DAY_BOUND)


def day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.split_by_day(_usage(spark, sf_dir), TRAIN_UNTIL, TEST_FROM)


def popular_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.popular_apps(_usage(spark, sf_dir), POPULAR_MIN_USERS)


def _valid_customers(spark, sf_dir) -> DataFrame:
    return tb.table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0).select(F.col("c_custkey").alias("user"))


def involved_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = us.involved_usage(_usage(spark, sf_dir), _valid_customers(spark, sf_dir), POPULAR_MIN_USERS)
    return us.user_app_sets(inv).select("user", "n_apps")


def user_app_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = us.user_app_sets(_usage(spark, sf_dir))
    return s.select("user", F.array_join(F.col("apps").cast("array<string>"), ",").alias("apps"), "n_apps")


def app_sets_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's app set in the 'user|a,b,c' line format."""
    return app_sets_to_text(us.user_app_sets(_usage(spark, sf_dir)))


def app_sets_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 read half: the lines of ``app_sets_text`` parsed, one row per user and app."""
    sets = app_sets_from_text(app_sets_text(spark, sf_dir))
    each = sets.select("user", F.explode("apps").alias("app"))
    return each.select(F.col("user").cast("bigint").alias("user"), F.col("app").cast("bigint").alias("app"))


# ---- contacts and components -------------------------------------------------------------

def voice_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.voice_graph(tb.contact_records(spark, sf_dir), tb.valid_users(spark, sf_dir), CONTACT_MIN_SEC)


def mutual_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.mutual_sms_graph(tb.contact_records(spark, sf_dir), tb.valid_users(spark, sf_dir))


def contact_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both graphs read the same records and valid set: one plan, reused exchanges
    records, valid = tb.contact_records(spark, sf_dir), tb.valid_users(spark, sf_dir)
    return ct.contact_graph(ct.voice_graph(records, valid, CONTACT_MIN_SEC), ct.mutual_sms_graph(records, valid))


def _component_edges(spark, sf_dir) -> DataFrame:
    """The contact graph (M3), as in the job chain; written once, as it is read several times."""
    return cut_lineage(contact_graph(spark, sf_dir))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.connected_components(_component_edges(spark, sf_dir))


def component_sizes_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = cc.top_components(components(spark, sf_dir), 10)
    return top.select("component", "size", F.col("rank").cast("bigint").alias("rank"))


def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.largest_component(components(spark, sf_dir))


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _component_edges(spark, sf_dir)
    return cc.induced_subgraph(edges, cc.largest_component(cc.connected_components(edges)))


def node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cc.consecutive_index(largest_component(spark, sf_dir), "node")


def node_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node index in the 'node,idx' line format."""
    return index_to_text(node_index(spark, sf_dir), "node", "idx")


def node_index_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 read half: the lines of ``node_index_text`` parsed."""
    return index_from_text(node_index_text(spark, sf_dir), "node", "idx")


def recoded_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component's edges with node ids recoded to the node index."""
    edges = _component_edges(spark, sf_dir)
    largest = cut_lineage(cc.largest_component(cc.connected_components(edges)))
    return cc.recode_edges(cc.induced_subgraph(edges, largest), cc.consecutive_index(largest, "node"))


def _record_lines(spark, sf_dir, *fields) -> DataFrame:
    """Contact records as '|' lines; ``fields`` are the columns or fillers after the second."""
    filler = F.lit("-")
    parts = [F.col(c).cast("string") if c else filler for c in ("sec", "src", *fields)]
    return tb.contact_records(spark, sf_dir).select(F.concat_ws("|", *parts).alias("value"))


def voice_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call lines parsed and counted by pair and day text."""
    log = parse_voice_log(voice_log_lines(spark, sf_dir))
    per_day = log.groupBy("src", "dst", epoch_to_day_text(F.col("sec")).alias("day"))
    return per_day.agg(F.count(F.lit(1)).alias("calls"), F.sum("dur").alias("dur")).withColumn("day", day_text_to_date(F.col("day")))


def voice_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_lines(spark, sf_dir, None, None, None, "dst", None, None, "dur")


def sms_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lines; flag O as 1, F as 0."""
    records = tb.contact_records(spark, sf_dir).withColumn("flag", F.when(F.col("flag") == "O", 1).otherwise(0))
    filler = F.lit("-")
    line = F.concat_ws("|", F.col("sec").cast("string"), "src", filler, filler, filler, "dst", filler, F.col("flag").cast("string"))
    return records.select(line.alias("value"))


def sms_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lines parsed and counted by pair and flag."""
    log = parse_sms_log(sms_log_lines(spark, sf_dir))
    return log.groupBy("src", "dst", "flag").agg(F.count(F.lit(1)).alias("messages"))


def components_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 for each of the source's call-duration bounds: components of the contact graphs, which are nested."""
    records, valid = tb.contact_records(spark, sf_dir), tb.valid_users(spark, sf_dir)
    records = cut_compact(joins.both_ends_in(records.select("src", "dst", "dur", "flag"), valid, "user"))  # calls and messages read it
    calls = joins.mirror(records.select("src", "dst", "dur"))
    calls = calls.groupBy("src", "dst").agg(F.max("dur").alias("dur"))
    # a mutual contact is one at every bound
    mutual = ct.mutual_sms_graph(records, None).withColumn("dur", F.lit(max(CONTACT_SECS) * 1000).cast("bigint"))
    found = cc.nested_components(calls.unionByName(mutual), "dur", [sec * 1000 for sec in CONTACT_SECS])
    return found.select((F.col("bound") / 1000).cast("bigint").alias("min_sec"), "node", "component")


# ---- kNN graphs ------------------------------------------------------------------------------

def _scored(topk: DataFrame, digits: int = 9) -> DataFrame:
    return topk.select("src", "dst", F.round("score", digits).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def direct_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(knn.jaccard_topk(tb.usage_log(spark, sf_dir), KNN_K, fill=True))


def direct_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.direct_graph(tb.usage_log(spark, sf_dir), KNN_K, fill=True)


def _order_days(spark, sf_dir) -> DataFrame:
    """A sparse usage table of all orders: the order's day stands for the app."""
    return tb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.to_date("o_orderdate").alias("app"))


def direct_knn_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(knn.jaccard_topk(_order_days(spark, sf_dir), SPARSE_K, fill=True))


def direct_knn_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(knn.jaccard_topk(_order_days(spark, sf_dir), SPARSE_K, fill=False))


def _embeddings(spark, sf_dir) -> DataFrame:
    return tb.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def cosine_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(knn.cosine_topk(_embeddings(spark, sf_dir), KNN_K), 6)


def cosine_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.symmetrize(knn.cosine_topk(_embeddings(spark, sf_dir), KNN_K))


def combined_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact graph united with the direct Jaccard graph (user ids as 'c' || custkey);
    M26, which takes the improved graph: ``combined_graph_improved``."""
    sim = knn.direct_graph(tb.usage_log(spark, sf_dir), KNN_K, fill=True).select(
        F.concat(F.lit("c"), F.col("src").cast("string")).alias("src"),
        F.concat(F.lit("c"), F.col("dst").cast("string")).alias("dst"),
    )
    return ct.union_graphs(contact_graph(spark, sf_dir), sim)


# ---- calendar, retention, exposure ---------------------------------------------------------

def calendar_next_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tb.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return ex.calendar(days, max_gap=CALENDAR_MAX_GAP)


def _events_model(spark, sf_dir, graph=tb.ring_graph):
    # the state feeds the split, both lookups and the calendar: write it once
    state = cut_lineage(ex.model_usage(tb.events_state(spark, sf_dir), None, MODEL_MIN_USERS))
    cal = ex.calendar(state.select("day"))
    return state, cal, graph(spark, sf_dir)


def retention_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = tb.events_state(spark, sf_dir)
    return ex.retention_labels(state, ex.calendar(state.select("day")))


def rows_with_neighbours(rows: DataFrame, links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exposure rows with the number of their neighbours and of those that used the app that day."""
    key = [*(by or []), "i", "j", "t"]
    per_row = links.groupBy(*key).agg(F.count(F.lit(1)).alias("n_nbrs"), F.sum("ml0").cast("bigint").alias("sum_ml0"))
    zero = F.lit(0)
    return rows.join(per_row, key, "left").select(
        *key, "m0", "m1", F.coalesce("n_nbrs", zero).cast("bigint").alias("n_nbrs"), F.coalesce("sum_ml0", zero).cast("bigint").alias("sum_ml0")
    )


def exposure_rows(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    state, cal, graph = _events_model(spark, sf_dir, graph=graph)
    return rows_with_neighbours(*ex.exposure_long(state, state, graph, cal))


def exposure_text(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    state, cal, graph = _events_model(spark, sf_dir, graph=graph)
    return exposure_to_text(ex.exposure_rows(state, state, graph, cal))


def exposure_decoded(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    """S13 read half: the lines of ``exposure_text`` parsed, neighbours counted."""
    rows = exposure_from_text(exposure_text(spark, sf_dir, graph=graph), "bigint", "string")
    total = F.aggregate("ni", F.lit(0).cast("bigint"), lambda s, x: s + x["ml0"])
    return rows.select("i", "j", "t", "m0", "m1", F.size("ni").cast("bigint").alias("n_nbrs"), total.alias("sum_ml0"))


def holdout_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19 with 3 of the source's 10 folds; all of them: ``holdout_days_full``."""
    days = tb.events_state(spark, sf_dir).select("day")
    return ex.holdout_days(days, HOLDOUT_FOLDS, 0.8, HOLDOUT_SEED)


# ---- logistic matrix factorisation -------------------------------------------------------------

def _positives(spark, sf_dir) -> DataFrame:
    return tb.usage_log(spark, sf_dir).select("user", "app").distinct()


def _rounded(df: DataFrame, cols: list[str], digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def negative_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.negative_samples(_positives(spark, sf_dir), LMF_SEED)


def train_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.training_samples(_positives(spark, sf_dir), LMF_SEED)


def factor_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fa.init_factors(_positives(spark, sf_dir), "user", LMF_RANK, LMF_SEED, "u")
    return _rounded(f, fa.fnames(LMF_RANK), 9)


def factors_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial user factors written as text lines and parsed again."""
    f = fa.factors_as_arrays(fa.init_factors(_positives(spark, sf_dir), "user", LMF_RANK, LMF_SEED, "u"), LMF_RANK)
    back = factors_from_text(factors_to_text(f))
    cols = [F.round(F.col("factor")[c], 9).alias(f"f{c}") for c in range(LMF_RANK)]
    return back.select(F.col("id").cast("bigint").alias("id"), *cols)


def vector_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    out = e.select(
        "vec_id",
        vx.norm("v").alias("norm"),
        vx.dot("v", "v").alias("self_dot"),
        total(vx.unit_vector("v")).alias("unit_sum"),
        vx.element("v", 0).alias("first"),
        total(vx.weighted_add("v", vx.unit_vector("v"), 2.0, 3.0)).alias("weighted_sum"),
        total(vx.add("v", vx.subtract(vx.scale("v", 3.0), "v"))).alias("add_sum"),
    )
    return _rounded(out, ["norm", "self_dot", "unit_sum", "first", "weighted_sum", "add_sum"], 6)


def _lmf_inputs(spark, sf_dir):
    pos = cut_compact(_positives(spark, sf_dir))
    samples = fa.prepare_samples(fa.training_samples(pos, LMF_SEED))
    U = cut_lineage(fa.init_factors(pos, "user", LMF_RANK, LMF_SEED, "u"))
    V = cut_lineage(fa.init_factors(pos, "app", LMF_RANK, LMF_SEED, "v"))
    return pos, samples, U, V


def logloss_at_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples, U, V = _lmf_inputs(spark, sf_dir)
    return _rounded(fa.losses(samples, U, V, LMF_RANK), ["train_loss", "observed_loss"], 8)


def lmf_grad_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples, U, V = _lmf_inputs(spark, sf_dir)
    return _rounded(fa.user_gradients(samples, U, V, LMF_RANK), fa.fnames(LMF_RANK, "g"), 8)


def lmf_grad_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples, U, V = _lmf_inputs(spark, sf_dir)
    return _rounded(fa.item_gradients(samples, U, V, LMF_RANK), fa.fnames(LMF_RANK, "g"), 8)


def lmf_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    _, samples, U, V = _lmf_inputs(spark, sf_dir)
    m, n = U.count(), V.count()
    U1, V1 = fa.lmf_step(samples, U, V, LMF_RANK, LMF_RATE, 1e-4 * math.sqrt(m), 1e-4 * math.sqrt(n))
    both = U1.withColumn("role", F.lit("u")).unionByName(V1.withColumn("role", F.lit("v")))
    return _rounded(both.select("role", "id", *fa.fnames(LMF_RANK)), fa.fnames(LMF_RANK), 8)


def lmf_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15..M17 with the source's 800 steps and 6 restarts."""
    res = fa.train_lmf(_positives(spark, sf_dir), LMF_RANK, LMF_RATE, LMF_STEPS, LMF_RESTARTS, seed=LMF_SEED)
    return _rounded(res.users, fa.fnames(LMF_RANK), 8)


def improved_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 (cosine kNN, symmetrised) on the factors of a run cut to 4 steps and 2 restarts; on trained ones: ``improved_knn_graph_full``."""
    res = fa.train_lmf(_positives(spark, sf_dir), LMF_RANK, LMF_RATE, LMF_TRAIN_STEPS, LMF_TRAIN_RESTARTS, seed=LMF_SEED)
    return knn.improved_graph(fa.factors_as_arrays(res.users, LMF_RANK), KNN_K)


# ---- exposure model ----------------------------------------------------------------------------

def _model_inputs(spark, sf_dir, d=MODEL_RANK, graph=tb.ring_graph):
    import math

    state, cal, graph = _events_model(spark, sf_dir, graph)
    rows, links = ex.exposure_long(state, state, graph, cal)
    rows = md.prepare(rows)  # reused by every pass below, as the terms; links are read once, for these
    terms = md.prepare(md.exposure_terms(rows, links), md.ROW + ["user"])
    U, V = (cut_lineage(x) for x in md.model_factors(rows, d, MODEL_SEED))
    lu, lv = 1e-4 * math.sqrt(U.count()), 1e-4 * math.sqrt(V.count())
    return rows, links, terms, U, V, lu, lv


def exposure_predict_rmse(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    rows, _, terms, U, V, _, _ = _model_inputs(spark, sf_dir, graph=graph)
    return md.rmse(rows, terms, U, V, MODEL_RANK).select(F.round("rmse", 8).alias("rmse"))


def newton_user_step(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    rows, _, terms, U, V, lu, _ = _model_inputs(spark, sf_dir, graph=graph)
    U1 = md.newton_user_step(rows, terms, U, V, MODEL_RANK, 0, lu)
    return _rounded(U1, fa.fnames(MODEL_RANK), 8)


def newton_item_step(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    rows, _, terms, U, V, lu, lv = _model_inputs(spark, sf_dir, graph=graph)
    U1 = md.newton_user_step(rows, terms, U, V, MODEL_RANK, 0, lu)
    V1 = md.newton_item_step(rows, terms, U1, V, MODEL_RANK, 0, lv)
    return _rounded(V1, fa.fnames(MODEL_RANK), 8)


def gd_user_step(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    rows, _, terms, U, V, lu, _ = _model_inputs(spark, sf_dir, graph=graph)
    U1 = md.gd_user_step(rows, terms, U, V, MODEL_RANK, 0, MODEL_GD_RATE, lu, rows.count())
    return _rounded(U1, fa.fnames(MODEL_RANK), 8)


def gd_item_step(spark: SparkSession, sf_dir: str, graph=tb.ring_graph) -> DataFrame:
    rows, _, terms, U, V, _, lv = _model_inputs(spark, sf_dir, graph=graph)
    V1 = md.gd_item_step(rows, terms, U, V, MODEL_RANK, 0, MODEL_GD_RATE, lv, rows.count())
    return _rounded(V1, fa.fnames(MODEL_RANK), 8)


def exposure_model_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M25 on the ring: the source's 10 folds, rank 7, up to 21 epochs. On the kNN graph: ``exposure_model_cv_full``."""
    state, cal, graph = _events_model(spark, sf_dir)
    rows, links = ex.exposure_long(state, state, graph, cal)
    folds = ex.holdout_days(rows.select(F.col("t").alias("day")), CV_FOLDS, 0.8, MODEL_SEED)
    scores, _ = md.cross_validate(rows, links, folds, MODEL_RANK, CV_EPOCHS, MODEL_SEED)
    return _rounded(scores, ["best_rmse"], 8)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M27's rank sweep on one graph, cut to ranks 1 and 2, 1 fold, 2 epochs: least and mean fold
    RMSE per rank. All of M27 (S x k x graph type, S x 15 ranks): ``sweep_full``."""
    from habitnet.plans.sweep import rank_sweep

    state, cal, graph = _events_model(spark, sf_dir)
    found = rank_sweep(state, graph, cal, SWEEP_RANKS, folds=1, max_epochs=2, seed=MODEL_SEED)
    return _rounded(found, ["min_rmse", "mean_rmse"], 8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "usage_daily": usage_daily,
    "usage_text_parse": usage_text_parse,
    "usage_union_sum": usage_union_sum,
    "host_app_match": host_app_match,
    "usage_stats": usage_stats,
    "usage_date_bound": usage_date_bound,
    "day_split": day_split,
    "popular_apps": popular_apps,
    "involved_users": involved_users,
    "user_app_sets": user_app_sets,
    "app_sets_text": app_sets_text,
    "app_sets_decoded": app_sets_decoded,
    "voice_text_parse": voice_text_parse,
    "sms_text_parse": sms_text_parse,
    "voice_contacts": voice_contacts,
    "mutual_contacts": mutual_contacts,
    "contact_graph": contact_graph,
    "components": components,
    "components_by_duration": components_by_duration,
    "component_sizes_top10": component_sizes_top10,
    "largest_component": largest_component,
    "induced_subgraph": induced_subgraph,
    "node_index": node_index,
    "node_index_text": node_index_text,
    "node_index_decoded": node_index_decoded,
    "recoded_subgraph": recoded_subgraph,
    "direct_knn_topk": direct_knn_topk,
    "direct_knn_graph": direct_knn_graph,
    "direct_knn_filled": direct_knn_filled,
    "direct_knn_positive": direct_knn_positive,
    "cosine_knn_topk": cosine_knn_topk,
    "cosine_knn_graph": cosine_knn_graph,
    "combined_graph": combined_graph,
    "calendar_next_day": calendar_next_day,
    "retention_labels": retention_labels,
    "exposure_rows": exposure_rows,
    "exposure_text": exposure_text,
    "exposure_decoded": exposure_decoded,
    "holdout_days": holdout_days,
    "negative_samples": negative_samples,
    "train_samples": train_samples,
    "factor_init": factor_init,
    "factors_decoded": factors_decoded,
    "vector_ops": vector_ops,
    "logloss_at_init": logloss_at_init,
    "lmf_grad_user": lmf_grad_user,
    "lmf_grad_item": lmf_grad_item,
    "lmf_one_step": lmf_one_step,
    "lmf_train": lmf_train,
    "improved_knn_graph": improved_knn_graph,
    "exposure_predict_rmse": exposure_predict_rmse,
    "newton_user_step": newton_user_step,
    "newton_item_step": newton_item_step,
    "gd_user_step": gd_user_step,
    "gd_item_step": gd_item_step,
    "exposure_model_cv": exposure_model_cv,
    "sweep": sweep,
}
