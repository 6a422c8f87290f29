"""Training where the samples lie, and queries that were cut before: their whole jobs."""

import datetime as dt
import inspect

import numpy as np
import pytest

import __spark_entry__ as se
from habitnet.operators import factor_whole as fw
from habitnet.operators import factors as fa
from habitnet.operators import model as md
from habitnet.operators.exposure import holdout_days

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


def test_lmf_train_runs_all_steps_and_restarts(spark, monkeypatch):
    got = arguments(monkeypatch, fa, "train_lmf", se.queries()["lmf_train"], spark)
    assert (got["d"], got["rate"], got["max_steps"], got["restarts"]) == (5, 1e-4, 800, 6)


# user 0 uses nearly all apps, user 9 one, app 3 is everybody's
PAIRS = [(0, a) for a in range(28)] + [(u, 3) for u in range(1, 10)] + [(u, a) for u in range(1, 8) for a in range(u % 3, 30, 5)]


def test_negatives_in_a_task_equal_the_joined_ones(spark):
    pairs = sorted(set(PAIRS))
    users, apps = (sorted({x[k] for x in pairs}) for k in (0, 1))
    pos = spark.createDataFrame(pairs, "user bigint, app bigint")
    order = [apps.index(r.app) for r in fa.app_permutation(pos.select("app"), 5).orderBy("pos").collect()]
    begin = {r.user: r.b for r in pos.select("user", fa.md5_int32(fa.F.lit("offset"), "user", 5).alias("b")).distinct().collect()}
    counts = np.array([sum(x == u for x, _ in pairs) for u in users])
    used = np.array([apps.index(a) for _, a in pairs], np.int32)
    for size in (1 << 20, 3):
        n, found = fw.drawn(counts, used, np.array([begin[u] % len(apps) for u in users]), np.array(order), size)
        got = {(u, apps[a]) for u, a in zip(np.repeat(users, n), found)}
        assert len(got) == len(found) and got == {tuple(r) for r in fa.negative_samples(pos, 5).collect()}


@pytest.mark.parametrize("options", [{"max_steps": 4, "rate": 0.05}, {"max_steps": 9, "rate": 1.6, "monitor": "observed"}])
def test_training_in_a_task_equals_training_on_tiles(spark, monkeypatch, options):
    pos = spark.createDataFrame([*PAIRS, *PAIRS[:5], (None, 3), (4, None)], "user bigint, app bigint")
    found = [fa.train_lmf(pos, d=3, restarts=2, seed=8, whole_samples=n, **options) for n in (0, fa.WHOLE_SAMPLES)]
    assert found[0].best_restart == found[1].best_restart
    for a, b in zip(found[0].history, found[1].history, strict=True):
        assert (a["restart"], a["step"]) == (b["restart"], b["step"]) and abs(a["observed_loss"] - b["observed_loss"]) < 1e-12
    for a, b in ((found[0].users, found[1].users), (found[0].items, found[1].items)):
        a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
        assert a and np.allclose(a, b, rtol=0, atol=1e-12)


def test_whole_restarts_need_no_rounds(spark, monkeypatch):
    """Before, every step of the smallest model was four shuffles."""
    monkeypatch.setattr(fa.bl, "rounds", lambda *_: pytest.fail("messages between places"))
    assert fa.train_lmf(spark.createDataFrame(PAIRS, "user bigint, app bigint"), d=2, max_steps=40, restarts=2).users.count() == 10


def test_exposure_model_cv_runs_all_folds_and_epochs(spark, monkeypatch):
    got = arguments(monkeypatch, md, "cross_validate", se.queries()["exposure_model_cv"], spark)
    assert (got["d"], got["max_epochs"]) == (7, 21)
    assert got["folds_days"].select("fold").distinct().count() == 10


def _exposure(spark):
    """Rows with a hub, equal rows, and rows without a user or a day."""
    days = [dt.date(1969, 12, 29) + dt.timedelta(days=k) for k in range(7)]
    rows = [(u, a, t, 1, (u * 3 + k + len(a)) % 2) for u in range(6) for a in ("A", "BB", "C") for k, t in enumerate(days) if (u + k) % 4]
    links = [(u, a, t, v, (u + v) % 3 and 1) for u, a, t, _, _ in rows for v in ((u + 1) % 6, 0, 77) if v != u]
    rows += [rows[0], rows[0], (None, "A", days[2], 1, 1), (2, "A", None, 1, 1), (2, None, days[2], 1, 0)]
    return (
        spark.createDataFrame(rows, "i bigint, j string, t date, m0 int, m1 int"),
        spark.createDataFrame(links, "i bigint, j string, t date, l bigint, ml0 int"),
    )


@pytest.mark.parametrize("solver, stop_ratio", [("newton", 1e9), ("gd", 1e9), ("newton", 1.0001)])
def test_models_in_a_task_equal_models_on_tiles(spark, solver, stop_ratio):
    rows, links = _exposure(spark)
    folds = holdout_days(rows.selectExpr("t AS day").where("t IS NOT NULL"), 3, 0.6, 1)
    found = [
        md.cross_validate_ranks(rows, links, folds, [3, 1], 6, 7, 0.01, solver, 0.3, stop_ratio=stop_ratio, whole_terms=n)
        for n in (0, md.ew.WHOLE_TERMS)
    ]
    (a, log), (b, other) = found
    assert len(log) == len(other) and len({x["epoch"] for x in log}) > 1
    key = lambda x: (x["rank"], x["fold"], x["epoch"])
    for x, y in zip(sorted(log, key=key), sorted(other, key=key)):
        assert key(x) == key(y) and all(abs(x[n] - y[n]) < 1e-10 for n in ("train_rmse", "valid_rmse"))
    a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
    assert len(a) == 6 and np.allclose(a, b, rtol=0, atol=1e-10)


def test_whole_models_need_no_rounds(spark, monkeypatch):
    """Before, every epoch of the smallest model was six shuffles."""
    monkeypatch.setattr(md.bl, "rounds", lambda *_: pytest.fail("messages between places"))
    rows, links = _exposure(spark)
    scores, _ = md.cross_validate(rows, links, holdout_days(rows.selectExpr("t AS day"), 2, 0.6, 1), d=2, max_epochs=5)
    assert scores.count() == 2


def test_files_of_candidates_are_freed_once_joined(spark, monkeypatch):
    """They stayed on disk while samples were ranked, stored, spread and joined."""
    freed = []
    monkeypatch.setattr(fa, "free_shuffles", freed.append)
    samples = fa.prepare_samples(fa.training_samples(spark.createDataFrame(PAIRS, "user bigint, app bigint"), 3))
    samples.unpersist()
    assert len(freed) == 2
