import math

import numpy as np
import pytest

from habitnet.operators import blocks as bl
from habitnet.operators import factor_blocks as fb
from habitnet.operators import factors as fa


def _pos(spark, rows):
    return spark.createDataFrame(rows, "user bigint, app bigint")


def test_negatives_disjoint_and_counts(spark):
    rows = [(u, a) for u in range(12) for a in range(0, 40, 3 + u % 4)] + [(99, a) for a in range(30)]  # 99 uses 30 of 40
    pos = _pos(spark, rows)
    neg = fa.negative_samples(pos, 7).collect()
    used = set(rows)
    assert not any((r.user, r.app) in used for r in neg)
    n_apps = len({a for _, a in rows})
    per = {}
    for r in neg:
        per[r.user] = per.get(r.user, 0) + 1
    for u in {u for u, _ in rows}:
        p = len({a for uu, a in rows if uu == u})
        assert per.get(u, 0) == min(p, n_apps - p)
    assert len({(r.user, r.app) for r in neg}) == len(neg)


def test_init_unit_vectors(spark):
    f = fa.init_factors(_pos(spark, [(1, 1), (2, 1)]), "user", 4, 3, "u").collect()
    for r in f:
        assert abs(math.sqrt(sum(r[f"f{c}"] ** 2 for c in range(4))) - 1) < 1e-12


def test_small_gradient_step_lowers_loss(spark):
    rows = [(u, a) for u in range(10) for a in range(u % 5, 15, 4)]
    pos = _pos(spark, rows)
    s = fa.training_samples(pos, 1)
    U = fa.init_factors(pos, "user", 3, 1, "u")
    V = fa.init_factors(pos, "app", 3, 1, "v")
    l0 = fa.losses(s, U, V, 3).first().train_loss
    U1, V1 = fa.lmf_step(s, U, V, 3, 0.05, 0.0, 0.0)
    l1 = fa.losses(s, U1, V1, 3).first().train_loss
    assert l1 < l0


def test_train_lmf_runs(spark):
    rows = [(u, a) for u in range(8) for a in range(u % 3, 12, 3)]
    res = fa.train_lmf(_pos(spark, rows), d=2, rate=0.05, max_steps=3, restarts=2, seed=5)
    assert res.users.count() == 8 and res.items.count() == 12 and res.best_restart in (0, 1)
    assert any(h["step"] == -1 for h in res.history)


HOT = [(0, a) for a in range(30)] + [(u, 3) for u in range(1, 30)] + [(u, a) for u in range(1, 8) for a in range(u % 3, 40, 5)]


def _plain_training(spark, rows, d, rate, steps, restarts, seed, stop_ratio=1.001, monitor="train", lam=1e-4):
    """The same training with numpy, one restart after the other, keeping snapshots."""
    pos = _pos(spark, rows)
    frames = [fa.init_factors(pos, key, d, seed, role).toPandas().sort_values("id") for key, role in (("user", "u"), ("app", "v"))]
    ids = [{k: n for n, k in enumerate(f["id"])} for f in frames]
    first = [f[fa.fnames(d)].to_numpy() for f in frames]
    reg = [lam * math.sqrt(len(x)) for x in first]
    results, history = [], []
    for rs in range(restarts):
        neg = [(r.user, r.app) for r in fa.negative_samples(pos, seed + rs).collect()]
        pairs = [*sorted(set(rows)), *neg]
        u, v = (np.array([i[p[n]] for p in pairs]) for n, i in enumerate(ids))
        r = np.array([1.0] * len(set(rows)) + [0.0] * len(neg))
        U, V, eta, best = *(x.copy() for x in first), rate, (math.inf,)
        for step in range(steps):
            p = (U[u] * V[v]).sum(1)
            loss = np.log1p(np.exp(-abs(p))) + np.maximum(p, 0) - r * p
            both = {"train": loss.mean(), "observed": loss[r == 1].mean()}
            history.append((rs, step, both["train"], both["observed"]))
            if both[monitor] < best[0]:
                best = (both[monitor], both["observed"], U.copy(), V.copy())
            elif both[monitor] > stop_ratio * best[0]:
                break
            g = np.zeros_like(U)
            np.add.at(g, u, (1 / (1 + np.exp(-p)) - r)[:, None] * V[v])
            U = U - eta * (g + reg[0] * U)
            p, g = (U[u] * V[v]).sum(1), np.zeros_like(V)
            np.add.at(g, v, (1 / (1 + np.exp(-p)) - r)[:, None] * U[u])
            V = V - eta * (g + reg[1] * V)
            eta /= 1.0001
        results.append(best)
    winner = min(range(restarts), key=lambda k: results[k][1])
    return winner, [dict(zip(i, x)) for i, x in zip(ids, results[winner][2:])], history


@pytest.mark.parametrize("options", [
    {"tile_rows": 60, "window": 2, "max_steps": 3, "rate": 0.05, "monitor": "observed"},
    {"window": 5, "max_steps": 12, "rate": 1.6},  # losses rise again: stop inside a window, earlier best step
])
def test_training_equals_plain_training(spark, options):
    rest = {k: v for k, v in options.items() if k not in ("tile_rows", "window")}
    res = fa.train_lmf(_pos(spark, HOT), d=2, restarts=3, seed=3, **options)
    winner, factors, history = _plain_training(spark, HOT, 2, rest["rate"], rest["max_steps"], 3, 3, monitor=rest.get("monitor", "train"))
    assert res.best_restart == winner
    got = [(h["restart"], h["step"], h["train_loss"], h["observed_loss"]) for h in res.history if h["step"] >= 0]
    assert [g[:2] for g in got] == [h[:2] for h in history]
    assert all(abs(x - y) < 1e-9 for g, h in zip(got, history) for x, y in zip(g[2:], h[2:]))
    for frame, want in zip((res.users, res.items), factors):
        found = {r.id: (r.f0, r.f1) for r in frame.collect()}
        assert found.keys() == want.keys()
        assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(found[k], want[k]))


def test_rising_losses_stop_before_the_end(spark):
    _, _, history = _plain_training(spark, HOT, 2, 1.6, 12, 3, 3)
    assert max(step for _, step, _, _ in history) < 11


def test_hot_user_and_hot_app_are_many_tiles(spark):
    """A third of the samples have one app, another third one user: no tile holds more than a small part."""
    rows = [(0, a) for a in range(2_000)] + [(u, 0) for u in range(1, 2_000)] + [(u, u) for u in range(1, 2_000)]
    pos = _pos(spark, rows)
    users, apps = bl.indexed(pos, "user", 4), bl.indexed(pos, "app", 4)
    samples = pos.selectExpr("user", "app", "0 AS restart", "1.0D AS r")
    sizes = [len(x.a) // 4 for x in fb.sample_tiles(samples, users, apps, 4, 1, 200).select("a").collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 400  # one tile of a pair of blocks would have about 700


def test_two_level_rank_of_negatives(spark):
    pos = _pos(spark, HOT)
    whole = {tuple(r) for r in fa.restart_negatives(pos, 5, 3).collect()}
    assert {tuple(r) for r in fa.restart_negatives(pos, 5, 3, cycle_chunk=3).collect()} == whole
    for rs in range(3):
        assert {(u, a) for r, u, a in whole if r == rs} == {tuple(r) for r in fa.negative_samples(pos, 5 + rs).collect()}


def test_jobs_do_not_grow_with_restarts(spark, monkeypatch):
    seen = []
    rounds = bl.rounds
    monkeypatch.setattr(bl, "rounds", lambda m, steps, parts: rounds(m, seen.append(len(steps)) or steps, parts))
    for restarts in (1, 4):
        fa.train_lmf(_pos(spark, HOT), d=2, rate=0.05, max_steps=4, restarts=restarts, window=2)
    assert seen[: len(seen) // 2] == seen[len(seen) // 2 :]
