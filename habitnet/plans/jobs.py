"""The three batch jobs of the source pipeline, composed from the operators.

1. ``usage_job``  (M7): web/other logs + host dictionary -> usage table.
2. ``graph_job``  (M1..M6, M8..M10, M15): contact graph, its largest
   component, the usage of its users, and the Jaccard and latent-factor kNN
   graphs for each k.
3. ``model_job``  (M18, M19, M25..M27): exposure rows on each graph and the
   repeated day hold-out score per graph and rank.

Every intermediate is written once under ``base`` (parquet, build-once,
S15) and read back, so a rerun resumes where it stopped and every stage
starts from a lineage-free scan.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.operators import components as cc
from habitnet.operators import contacts as ct
from habitnet.operators import exposure as ex
from habitnet.operators import factors as fa
from habitnet.operators import knn
from habitnet.operators import model as md
from habitnet.operators import usage as us
from habitnet.sources import logs
from habitnet.sources.codecs import materialize


def _p(base: str, *parts: str, **parameters) -> str:
    """A folder below ``base``, its last part followed by a hash of ``parameters`` (if any),
    so that a call with other parameters never reads what these built."""
    if parameters:
        code = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:12]
        parts = (*parts[:-1], f"{parts[-1]}-{code}")
    return "/".join([base.rstrip("/"), *parts])


def usage_job(spark: SparkSession, base: str, log_paths: Iterable[str], host_app_path: str, before: str | None = None) -> DataFrame:
    """Job 1: one read over all log parts, app match, day, bound, count."""
    def build() -> DataFrame:
        log = logs.read_web_log(spark, list(log_paths))
        return us.format_usage(log, logs.read_host_app(spark, host_app_path), before)

    return materialize(spark, _p(base, "usage", before=before), build)


def graph_job(spark: SparkSession, base: str, usage: DataFrame, voice_paths: Iterable[str], sms_paths: Iterable[str],
              valid_users_path: str, min_sec: int, ks: Iterable[int], min_users: int = 10, rank: int = 5,
              lmf_steps: int = 800, lmf_restarts: int = 6, seed: int = 42) -> dict[str, DataFrame]:
    """Job 2 for one duration bound ``min_sec``.

    Returns the contact graph, the largest component's nodes and subgraph,
    the involved usage, and ``direct_k`` / ``improved_k`` graphs for each k.
    """
    voice, sms = logs.read_voice_log(spark, list(voice_paths)), logs.read_sms_log(spark, list(sms_paths))
    valid = logs.read_id_list(spark, valid_users_path, "user")
    return graphs_of(spark, base, usage, voice, sms, valid, min_sec, ks, min_users, rank, lmf_steps, lmf_restarts, seed)


def graphs_of(spark: SparkSession, base: str, usage: DataFrame, voice: DataFrame, sms: DataFrame, valid: DataFrame,
              min_sec: int, ks: Iterable[int], min_users: int = 10, rank: int = 5, lmf_steps: int = 800,
              lmf_restarts: int = 6, seed: int = 42) -> dict[str, DataFrame]:
    """``graph_job`` on parsed call and message records and the valid users."""
    tag = f"s{min_sec}"
    contacts = materialize(spark, _p(base, tag, "contacts"), lambda: ct.contact_graph(
        ct.voice_graph(voice, valid, min_sec), ct.mutual_sms_graph(sms, valid)))
    comps = materialize(spark, _p(base, tag, "components"), lambda: cc.connected_components(contacts))
    largest = materialize(spark, _p(base, tag, "largest"), lambda: cc.largest_component(comps))
    subgraph = materialize(spark, _p(base, tag, "subgraph"), lambda: cc.induced_subgraph(contacts, largest))
    involved = materialize(spark, _p(base, tag, "involved", min_users=min_users), lambda: us.involved_usage(
        usage, largest.select(F.col("node").alias("user")), min_users))
    lmf = {"min_users": min_users, "rank": rank, "steps": lmf_steps, "restarts": lmf_restarts, "seed": seed}
    factors = materialize(spark, _p(base, tag, f"lmf_{rank}", **lmf), lambda: fa.factors_as_arrays(
        fa.train_lmf(involved, rank, 1e-4, lmf_steps, lmf_restarts, seed=seed).users, rank))
    out = {"contacts": contacts, "components": comps, "largest": largest, "subgraph": subgraph, "involved": involved, "factors": factors}
    for k in ks:
        out[f"direct_{k}"] = materialize(spark, _p(base, tag, f"direct_{k}", min_users=min_users), lambda k=k: knn.direct_graph(involved, k))
        out[f"improved_{k}"] = materialize(spark, _p(base, tag, f"improved_{k}", **lmf), lambda k=k: knn.improved_graph(factors, k))
    return out


def exposure_job(spark: SparkSession, base: str, state: DataFrame, graph: DataFrame, cal: DataFrame, train_until: str,
                 test_from: str) -> dict[str, DataFrame]:
    """M18 for both parts of the days (P11): ``rows`` and ``links`` with their ``part``, stored once in folders by part.

    Each part's rows and neighbours are those of its own days and users; m1 and ml0 look up the whole ``state``.
    """
    split = us.split_by_day(state, train_until, test_from)
    built: list = []

    def both() -> list[tuple[DataFrame, ...]]:
        if not built:
            for part in ("train", "test"):
                own = ex.exposure_long(split.where(F.col("part") == part).drop("part"), state, graph, cal)
                built.append(tuple(x.withColumn("part", F.lit(part)) for x in own))
        return built

    where = {"train_until": train_until, "test_from": test_from}
    return {
        name: materialize(spark, _p(base, "exposure", name, **where), lambda n=n: both()[0][n].unionByName(both()[1][n]), parts="part")
        for n, name in enumerate(("rows", "links"))
    }


def model_job(spark: SparkSession, base: str, usage: DataFrame, graphs: dict[str, DataFrame], users: DataFrame,
              ranks: Iterable[int] = (7,), folds: int = 10, max_epochs: int = 21, min_users: int = 10,
              max_gap: int = 1, train_until: str | None = None, seed: int = 42, bridges: DataFrame | None = None,
              terminals: Iterable[str] | None = None) -> DataFrame:
    """Job 3: (graph, rank, min_rmse, mean_rmse) for every graph and rank.

    ``users`` are the model's users (the largest component); the usage is
    restricted to them and to apps with at least ``min_users`` users. With
    ``train_until`` only days up to it are scored (the later part is the
    held-out test period).
    """
    who = users.agg(F.bit_xor(F.xxhash64("user")), F.count("user")).first()
    state = materialize(spark, _p(base, "model", "state", min_users=min_users, users=list(who)), lambda: ex.model_usage(usage, users, min_users))
    split = state if train_until is None else state.where(F.col("day") <= F.lit(train_until).cast("date"))
    cal = ex.calendar(state.select("day"), max_gap=max_gap, bridges=bridges, terminals=terminals)
    results = None
    for name, g in graphs.items():
        rows, links = ex.exposure_long(split, state, g, cal)
        fd = ex.holdout_days(rows.select(F.col("t").alias("day")), folds, 0.8, seed)
        scores, _ = md.cross_validate_ranks(rows, links, fd, ranks, max_epochs, seed)
        row = scores.groupBy(F.lit(name).alias("graph"), "rank").agg(F.min("best_rmse").alias("min_rmse"), F.avg("best_rmse").alias("mean_rmse"))
        results = row if results is None else results.unionByName(row)
    return results


def sweep_job(spark: SparkSession, base: str, usage: DataFrame, voice_paths: Iterable[str], sms_paths: Iterable[str],
              valid_users_path: str, secs: Iterable[int] = (15, 20, 25, 30), ks: Iterable[int] = range(1, 16),
              ranks: Iterable[int] = range(1, 16), model_rank: int = 7, combined_k: int = 10, folds: int = 10,
              max_epochs: int = 21, min_users: int = 10, lmf_steps: int = 800, lmf_restarts: int = 6,
              seed: int = 42, **model) -> DataFrame:
    """The whole parameter sweep as one result frame
    (sec, graph, rank, min_rmse, mean_rmse).

    For every duration bound: the direct and improved k-NN graphs for each k
    at ``model_rank``, then the combined graph (contacts united with the
    improved ``combined_k``-NN graph, M26) at every rank in ``ranks``.
    Built graphs are stored once under ``base`` and reused by later calls.
    ``min_users`` bounds the graphs' apps; ``model`` may state the model's own
    ``model_min_users``, and ``max_gap``, ``train_until``, ``bridges`` and ``terminals``.
    """
    voice, sms = logs.read_voice_log(spark, list(voice_paths)), logs.read_sms_log(spark, list(sms_paths))
    valid = logs.read_id_list(spark, valid_users_path, "user")
    return sweep_of(spark, base, usage, voice, sms, valid, secs, ks, ranks, model_rank, combined_k, folds, max_epochs,
                    min_users, lmf_steps, lmf_restarts, seed, **model)


def sweep_of(spark: SparkSession, base: str, usage: DataFrame, voice: DataFrame, sms: DataFrame, valid: DataFrame,
             secs: Iterable[int] = (15, 20, 25, 30), ks: Iterable[int] = range(1, 16), ranks: Iterable[int] = range(1, 16),
             model_rank: int = 7, combined_k: int = 10, folds: int = 10, max_epochs: int = 21, min_users: int = 10,
             lmf_steps: int = 800, lmf_restarts: int = 6, seed: int = 42, model_min_users: int | None = None, **model) -> DataFrame:
    """``sweep_job`` on parsed call and message records and the valid users."""
    own = min_users if model_min_users is None else model_min_users
    ks, ranks = list(ks), list(ranks)
    out = None
    for sec in secs:
        g = graphs_of(spark, base, usage, voice, sms, valid, sec, sorted(set(ks) | {combined_k}),
                      min_users, 5, lmf_steps, lmf_restarts, seed)
        users = g["largest"].select(F.col("node").alias("user"))
        mbase = _p(base, f"s{sec}")
        knn_graphs = {f"{kind}_{k}": g[f"{kind}_{k}"] for k in ks for kind in ("direct", "improved")}
        a = model_job(spark, mbase, usage, knn_graphs, users, [model_rank], folds, max_epochs, own, seed=seed, **model)
        combined = ct.union_graphs(g["subgraph"], g[f"improved_{combined_k}"])
        b = model_job(spark, mbase, usage, {"combined": combined}, users, ranks, folds, max_epochs, own, seed=seed, **model)
        res = a.unionByName(b).withColumn("sec", F.lit(sec))
        out = res if out is None else out.unionByName(res)
    return out.select("sec", "graph", "rank", "min_rmse", "mean_rmse")
