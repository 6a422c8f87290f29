"""Registered queries that run the source's whole job: its own constants, which are the operators' defaults.

The training queries of ``queries.py`` are cut to a size that tests can run; these
are not. Only the early stop of the training loops may end one of them sooner.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.operators import contacts as ct
from habitnet.operators import exposure as ex
from habitnet.operators import factors as fa
from habitnet.operators import knn
from habitnet.operators import model as md
from habitnet.plans import jobs
from habitnet.plans import queries as qs
from habitnet.session import checkpoint_dir, cut_lineage
from habitnet.sources import tables as tb

FOLDS = 10                        # repeated day hold-out of the source


def holdout_days_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten folds."""
    return ex.holdout_days(tb.events_state(spark, sf_dir).select("day"), FOLDS)


def lmf_train_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15..M17: rank 5, up to 800 steps, 6 restarts."""
    return fa.train_lmf(qs._positives(spark, sf_dir)).users


def improved_knn_graph_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 on the factors of ``lmf_train_full``."""
    return knn.improved_graph(fa.factors_as_arrays(lmf_train_full(spark, sf_dir), qs.LMF_RANK), qs.KNN_K)


def exposure_model_cv_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M25 on the kNN graph: ten folds, rank 7, up to 21 epochs."""
    state, cal, graph = qs._events_model(spark, sf_dir, events_knn_graph)
    rows, links = ex.exposure_long(state, state, graph, cal)
    scores, _ = md.cross_validate(rows, links, ex.holdout_days(rows.select(F.col("t").alias("day")), FOLDS))
    return scores


def sweep_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M27 on the order tables: for each S the direct and improved graphs of k = 1..15 at rank 7,
    and ranks 1..15 on the combined graph. Graphs are built anew under the checkpoint folder."""
    usage = qs._usage(spark, sf_dir).withColumn("user", F.concat(F.lit("c"), F.col("user").cast("string")))
    records = tb.contact_records(spark, sf_dir)
    base = f"{checkpoint_dir(spark)}/sweep-{uuid.uuid4().hex}"
    return jobs.sweep_of(spark, base, usage, records, records, tb.valid_users(spark, sf_dir))


def combined_graph_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact graph united with the improved 10-NN graph (user ids as 'c' || custkey)."""
    sim = improved_knn_graph_full(spark, sf_dir)
    ids = [F.concat(F.lit("c"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")]
    return ct.union_graphs(qs.contact_graph(spark, sf_dir), sim.select(*ids))


def events_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct 10-NN graph of the ``events`` users on what they did on which day: with the event types alone
    nearly all app sets, and so all scores, are equal. Users with few overlaps fill up with the least ids, which become hubs."""
    state = tb.events_state(spark, sf_dir)
    done = state.select("user", F.concat_ws("@", "app", F.col("day").cast("string")).alias("app"))
    return cut_lineage(knn.direct_graph(done, qs.KNN_K))


#: Exposure and model queries on the kNN graph instead of the ring.
ON_KNN = (
    "exposure_rows", "exposure_text", "exposure_decoded", "exposure_predict_rmse",
    "newton_user_step", "newton_item_step", "gd_user_step", "gd_item_step",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "holdout_days_full": holdout_days_full,
    "lmf_train_full": lmf_train_full,
    "improved_knn_graph_full": improved_knn_graph_full,
    "exposure_model_cv_full": exposure_model_cv_full,
    "sweep_full": sweep_full,
    "combined_graph_improved": combined_graph_improved,
    **{f"{name}_knn": partial(qs.QUERIES[name], graph=events_knn_graph) for name in ON_KNN},
}
