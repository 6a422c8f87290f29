"""The whole-job queries: the source's constants, and oracles derived from the cut queries' SQL."""

import inspect

import duckdb
import pytest

import __spark_entry__ as se
from habitnet.operators import factors as fa
from habitnet.operators import model as md
from habitnet.plans import full, jobs
from habitnet.plans import queries as qs
from habitnet.plans.oracle import SQL
from tools.oracle_check import TABLES, digest

SF_DIR = "/root/testdata/sf0.001"


class Called(Exception):
    """Ends a query at the call that is looked at."""


def arguments(monkeypatch, module, name, query, spark):
    """What ``query`` passes to ``module.name``, defaults filled in."""
    signature = inspect.signature(getattr(module, name))

    def stop(*args, **kwargs):
        raise Called(args, kwargs)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Called) as called:
        query(spark, SF_DIR)
    bound = signature.bind(*called.value.args[0], **called.value.args[1])
    bound.apply_defaults()
    return bound.arguments


WITH_SQL = sorted(k for k in SQL if k in full.QUERIES)


def test_oracles_of_whole_jobs():
    assert WITH_SQL == sorted(["holdout_days_full", *(f"{name}_knn" for name in full.ON_KNN)])
    assert set(WITH_SQL) <= set(se.oracle_sql())


@pytest.mark.parametrize("name", ["lmf_train_full", "improved_knn_graph_full"])
def test_training_runs_all_steps_and_restarts(spark, monkeypatch, name):
    got = arguments(monkeypatch, fa, "train_lmf", se.queries()[name], spark)
    assert (got["d"], got["rate"], got["max_steps"], got["restarts"]) == (5, 1e-4, 800, 6)


def test_cross_validation_runs_all_folds_and_epochs(spark, monkeypatch):
    got = arguments(monkeypatch, md, "cross_validate", se.queries()["exposure_model_cv_full"], spark)
    assert (got["d"], got["max_epochs"]) == (7, 21)
    assert got["folds_days"].select("fold").distinct().count() == 10


def test_size_estimates_stay_small_over_steps(spark):
    """They were a product over all steps before: at the source's 800 they ended the driver's memory."""
    pos = spark.createDataFrame([(u, a) for u in range(6) for a in range(u, u + 3)], "user long, app long")
    res = fa.train_lmf(pos, d=2, max_steps=6, restarts=1)
    for frame in (res.users, res.items):
        size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        assert int(str(size)) < 1 << 63


def test_sweep_covers_every_graph_and_rank(spark, monkeypatch):
    asked = []

    def graphs(spark, base, usage, voice, sms, valid, sec, ks, min_users, rank, steps, restarts, seed):
        assert (steps, restarts) == (800, 6)
        users = usage.select("user").withColumnRenamed("user", "node").distinct()
        edges = users.selectExpr("node AS src", "node AS dst")
        return {"largest": users, "subgraph": edges} | {f"{kind}_{k}": edges for k in ks for kind in ("direct", "improved")}

    def model(spark, base, usage, graphs, users, ranks, folds, max_epochs, min_users, seed):
        assert (folds, max_epochs) == (10, 21)
        asked.extend((base.rsplit("/", 1)[-1], g, d) for g in graphs for d in ranks)
        return spark.createDataFrame([("g", 1, 0.0, 0.0)], "graph string, rank int, min_rmse double, mean_rmse double")

    monkeypatch.setattr(jobs, "graphs_of", graphs)
    monkeypatch.setattr(jobs, "model_job", model)
    assert se.queries()["sweep_full"](spark, SF_DIR).columns == ["sec", "graph", "rank", "min_rmse", "mean_rmse"]
    knn = {(f"{kind}_{k}", 7) for k in range(1, 16) for kind in ("direct", "improved")}
    want = knn | {("combined", d) for d in range(1, 16)}
    assert sorted(asked) == sorted((f"s{sec}", *x) for sec in (15, 20, 25, 30) for x in want)


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def same(frame, sql):
    rows, cur = [tuple(r) for r in frame.collect()], connection().execute(sql)
    columns = [c[0] for c in cur.description]
    assert rows and sorted(columns) == sorted(frame.columns)
    assert digest(frame.columns, rows)[0] == digest(columns, cur.fetchall())[0]


@pytest.mark.parametrize("name", WITH_SQL)
def test_whole_job_equals_its_sql(spark, name):
    same(se.queries()[name](spark, SF_DIR), SQL[name])


def test_combined_graph_holds_the_improved_one(spark, monkeypatch):
    trained = fa.train_lmf
    monkeypatch.setattr(fa, "train_lmf", lambda pos: trained(pos, max_steps=2, restarts=1))
    improved = {(f"c{r.src}", f"c{r.dst}") for r in full.improved_knn_graph_full(spark, SF_DIR).collect()}
    contacts = {(r.src, r.dst) for r in qs.contact_graph(spark, SF_DIR).collect()}
    rows = [(r.src, r.dst) for r in se.queries()["combined_graph_improved"](spark, SF_DIR).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == improved | contacts


def test_knn_graph_has_hubs(spark):
    most = full.events_knn_graph(spark, SF_DIR).groupBy("src").count().agg({"count": "max"}).first()[0]
    assert most > 10
