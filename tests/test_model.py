import datetime as dt

import pytest

from habitnet.operators import exposure_blocks as eb
from habitnet.operators import model as md
from habitnet.operators.exposure import holdout_days


def D(s):
    return dt.date.fromisoformat(s)


def test_newton_equals_closed_form_rank1(spark):
    # one user, one item, rank 1, no neighbours: p = u*v, e = p - m1
    rows = spark.createDataFrame([(1, "A", D("2017-01-01"), 1, 1), (1, "A", D("2017-01-02"), 1, 0), (1, "A", D("2017-01-03"), 1, 1)],
                                 "i bigint, j string, t date, m0 int, m1 int")
    links = spark.createDataFrame([], "i bigint, j string, t date, l bigint, ml0 int")
    terms = md.exposure_terms(rows, links)
    U = spark.createDataFrame([(1, 0.5)], "id bigint, f0 double")
    V = spark.createDataFrame([("A", 0.8)], "id string, f0 double")
    U1 = md.newton_user_step(rows, terms, U, V, 1, 0, 0.0).first().f0
    # least squares in u: minimise sum (u v - m1)^2 -> u = sum(m1) v / (n v^2)
    assert abs(U1 - (2 * 0.8) / (3 * 0.8 ** 2)) < 1e-12
    V1 = md.newton_item_step(rows, terms, spark.createDataFrame([(1, U1)], "id bigint, f0 double"), V, 1, 0, 0.0).first().f0
    assert abs(V1 - (2 * U1) / (3 * U1 ** 2)) < 1e-12
    assert abs(md.rmse(rows, terms, U, V, 1).first().rmse - ((0.4 - 1) ** 2 * 2 / 3 + 0.4 ** 2 / 3) ** 0.5) < 1e-12


def test_neighbour_weights(spark):
    rows = spark.createDataFrame([(1, "A", D("2017-01-01"), 1, 1)], "i bigint, j string, t date, m0 int, m1 int")
    links = spark.createDataFrame([(1, "A", D("2017-01-01"), 2, 1), (1, "A", D("2017-01-01"), 3, 0)],
                                  "i bigint, j string, t date, l bigint, ml0 int")
    terms = {(r.user, r.w) for r in md.exposure_terms(rows, links).collect()}
    assert terms == {(1, 1.0), (2, 0.5)}  # ml0 / |N(i)|, zero terms dropped
    U = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0)], "id bigint, f0 double")
    V = spark.createDataFrame([("A", 1.0)], "id string, f0 double")
    p = md.predictions(rows, md.exposure_terms(rows, links), U, V, 1).first().p
    assert p == 1.0 + 0.5 * 2.0


def test_next_coordinate():
    assert all(md.next_coordinate(1, 0, 3, 0, e) == 0 for e in range(5))
    last = -1
    for e in range(20):
        c = md.next_coordinate(4, last, 3, 1, e)
        assert 0 <= c < 4 and c != last
        last = c


def test_cross_validate_runs(spark):
    days = [D("2017-01-01") + dt.timedelta(days=k) for k in range(6)]
    rows = spark.createDataFrame([(u, a, d, 1, (u + k) % 2) for u in range(4) for a in ("A", "B") for k, d in enumerate(days)],
                                 "i bigint, j string, t date, m0 int, m1 int")
    links = spark.createDataFrame([(u, a, d, (u + 1) % 4, 1) for u in range(4) for a in ("A",) for d in days],
                                  "i bigint, j string, t date, l bigint, ml0 int")
    fd = holdout_days(rows.selectExpr("t AS day"), 2, 0.8, 1)
    scores, log = md.cross_validate(rows, links, fd, d=2, max_epochs=3)
    assert scores.count() == 2 and len(log) >= 2


def _spread(spark, hub=True):
    days = [D("2017-01-01") + dt.timedelta(days=k) for k in range(6)]
    apps = ("A", "BB", "C")
    rows = [(u, a, d, 1, (u * 3 + k + len(a)) % 2) for u in range(6) for a in apps for k, d in enumerate(days) if (u + k) % 4]
    links = [(u, a, d, l, (u + l) % 3 and 1) for u, a, d, _, _ in rows for l in {(u + 1) % 6, 0 if hub else u} if l != u]  # user 0 is a hub
    return (
        spark.createDataFrame(rows, "i bigint, j string, t date, m0 int, m1 int"),
        spark.createDataFrame(links, "i bigint, j string, t date, l bigint, ml0 int"),
    )


def test_epochs_match_single_steps(spark):
    """The batched epochs against the operators of one step, joined and summed by Spark."""
    rows, links = _spread(spark)
    fd = holdout_days(rows.selectExpr("t AS day"), 1, 0.8, 1)
    _, log = md.cross_validate(rows, links, fd, d=3, max_epochs=2, seed=11, lam=0.01)
    train = rows.join(fd.where("is_train").selectExpr("day AS t"), "t", "left_semi")
    valid = rows.join(fd.where("NOT is_train").selectExpr("day AS t"), "t", "left_semi")
    terms = md.exposure_terms(rows, links)
    own = [terms.join(x, md.ROW, "left_semi") for x in (train, valid)]
    U0, V0 = md.model_factors(rows, 3, 11)
    lu, lv = 0.01 * U0.count() ** 0.5, 0.01 * V0.count() ** 0.5
    c = md.next_coordinate(3, -1, 11, 0, 0)
    U1 = md.newton_user_step(train, own[0], U0, V0, 3, c, lu)
    V1 = md.newton_item_step(train, own[0], U1, V0, 3, c, lv)
    for epoch, (U, V) in enumerate(((U0, V0), (U1, V1))):
        want = [md.rmse(x, t, U, V, 3).first().rmse for x, t in zip((train, valid), own)]
        assert abs(log[epoch]["train_rmse"] - want[0]) < 1e-12 and abs(log[epoch]["valid_rmse"] - want[1]) < 1e-12


def _plain(spark, rows, links, fd, ranks, epochs, seed, lam, solver, rate):
    """Cross-validation with plain loops: {(rank, fold): [(train rmse, valid rmse)]}, all epochs."""
    r = [tuple(x) for x in rows.select("i", "j", "t", "m1").collect()]
    terms = {}
    for i, j, t, user, w in (tuple(x) for x in md.exposure_terms(rows, links).collect()):
        terms.setdefault((i, j, t), []).append((user, w))
    days = {(x.fold, x.day): x.is_train for x in fd.collect()}
    out = {}
    for d in ranks:
        first = [{x.id: [x[f"f{c}"] for c in range(d)] for x in f.collect()} for f in md.model_factors(rows, d, seed)]
        reg = [lam * len(x) ** 0.5 for x in first]
        for fold in sorted({f for f, _ in days}):
            U, V = ({k: list(v) for k, v in x.items()} for x in first)
            last, log = -1, []
            for epoch in range(epochs):
                def predicted():
                    x = {k[:3]: [sum(w * U[u][c] for u, w in terms.get(k[:3], [])) for c in range(d)] for k in r}
                    return x, {k[:3]: sum(a * b for a, b in zip(x[k[:3]], V[k[1]])) - k[3] for k in r}

                x, e = predicted()
                part = lambda flag: [e[k[:3]] ** 2 for k in r if days[fold, k[2]] is flag]
                log.append(tuple((sum(p) / len(p)) ** 0.5 for p in (part(True), part(False))))
                c = last = md.next_coordinate(d, last, seed, fold, epoch)
                train = [k[:3] for k in r if days[fold, k[2]]]

                def move(table, sums, lam):
                    for k, (a, b) in sums.items():
                        old = table[k][c]
                        push = lam * ((old > 0) - (old < 0))
                        if solver == "gd":
                            table[k][c] = old - rate * (b / len(train) + push)
                        elif b and a > 0:
                            table[k][c] = old - (b + push) / a

                sums = {}
                for k in train:
                    for u, w in terms.get(k, []):
                        a, own = w * V[k[1]][c], sums.setdefault(u, [0, 0])
                        own[0] += a * a
                        own[1] += a * e[k]
                move(U, sums, reg[0])
                x, e = predicted()
                sums = {}
                for k in train:
                    own = sums.setdefault(k[1], [0, 0])
                    own[0] += x[k][c] ** 2
                    own[1] += x[k][c] * e[k]
                move(V, sums, reg[1])
            out[d, fold] = log
    return out


@pytest.mark.parametrize("solver", ["newton", "gd"])
def test_all_folds_and_ranks_equal_plain_loops(spark, solver):
    rows, links = _spread(spark)
    fd = holdout_days(rows.selectExpr("t AS day"), 3, 0.8, 1)
    want = _plain(spark, rows, links, fd, [1, 3], 5, 7, 0.01, solver, 0.3)
    sizes = {"tile_rows": 9, "place_rows": 11, "window": 2}
    for options in ({}, sizes) if solver == "newton" else (sizes,):
        scores, log = md.cross_validate_ranks(rows, links, fd, [3, 1], 5, 7, 0.01, solver, 0.3, stop_ratio=1e9, **options)
        got = {}
        for x in log:
            got.setdefault((x["rank"], x["fold"]), []).append((x["train_rmse"], x["valid_rmse"]))
        assert got.keys() == want.keys()
        assert all(abs(a - b) < 1e-9 for k in want for x, y in zip(got[k], want[k]) for a, b in zip(x, y))
        assert all(len(got[k]) == len(want[k]) == 5 for k in want)
        best = {(x.rank, x.fold): x.best_rmse for x in scores.collect()}
        assert all(abs(best[k] - min(v for _, v in want[k])) < 1e-9 for k in want)


def test_stop_ends_a_models_log(spark):
    assert md._until_stop([3.0, 2.0, 2.01, 2.03, 1.0], 1.01) == 4
    assert md._until_stop([3.0, 2.0, 1.0], 1.01) == 3 and md._until_stop([float("inf")], 1.01) == 1


def test_columns_and_folds_in_groups(spark, monkeypatch):
    """More columns than train together, more folds than a mask has bits: groups, same scores."""
    rows, links = _spread(spark)
    fd = holdout_days(rows.selectExpr("t AS day"), 5, 0.8, 1)
    one, _ = md.cross_validate_ranks(rows, links, fd, [1, 2], 2, 7)
    monkeypatch.setattr(md, "MAX_COLUMNS", 4)
    monkeypatch.setattr(md, "MAX_FOLDS", 2)
    many, _ = md.cross_validate_ranks(rows, links, fd, [1, 2], 2, 7)
    a, b = ({(x.rank, x.fold): x.best_rmse for x in f.collect()} for f in (one, many))
    # fold numbers seed the coordinates: groups count folds from 0, scores must not show it
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_hub_terms_are_many_tiles(spark):
    """A hub's rows have most terms: they are spread over user blocks and chunks."""
    rows = spark.createDataFrame([(u, "A", D("2017-01-01"), 1, 0) for u in range(400)], "i bigint, j string, t date, m0 int, m1 int")
    links = spark.createDataFrame([(0, "A", D("2017-01-01"), u, 1) for u in range(1, 400)], "i bigint, j string, t date, l bigint, ml0 int")
    fd = holdout_days(rows.selectExpr("t AS day"), 1, 0.8, 1)
    found = eb.problem(rows, md.exposure_terms(rows, links), eb.fold_bits(fd), 4, tile_rows=50)
    sizes = [len(x.a) // 4 for x in found.tiles.select("a").collect()]
    found.free()
    assert sum(sizes) == 799 and max(sizes) < 200


def test_terms_do_not_move_links(spark):
    """Links lie by user and app as ``exposure_long`` leaves them: the terms' weights need no other shuffle of them."""
    from habitnet.operators import exposure as ex

    state = spark.range(30).selectExpr("id AS user", "'A' AS app", "explode(sequence(date'2020-01-01', date'2020-01-06')) AS day")
    graph = spark.range(30).selectExpr("id AS src", "explode(array((id + 1) % 30, (id + 7) % 30, (id * 3 + 2) % 30)) AS dst")
    rows, links = ex.exposure_long(state, state, graph, ex.calendar(state.select("day")))
    terms = md.exposure_terms(rows, links)
    nbs = {}
    for r in links.collect():
        nbs.setdefault((r.i, r.j, r.t), []).append(r)
    want = [(*key, r.l, r.ml0 / len(found)) for key, found in nbs.items() for r in found if r.ml0] + [(r.i, r.j, r.t, r.i, 1.0) for r in rows.collect()]
    assert sorted(map(tuple, terms.collect())) == sorted(want)
    counted = md.exposure_terms(rows.limit(0), links)
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Window" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
