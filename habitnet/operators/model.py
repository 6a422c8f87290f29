"""Neighbour-exposure factor model and its repeated day hold-out (M19..M25, M27; A11, A15, F12).

Relational form. Every exposure row r = (i, j, t) becomes *terms*
(r, user, w): (i, m0) for the row's owner and (l, ml0 / max(|N(i)|, 1)) for
each neighbour. Then

    x_r = sum_terms w * u_user         (a d-vector per row)
    p_r = x_r . v_j,   e_r = p_r - m1_r

and with the coordinate c of the epoch

* users: a = w * v_j[c] per term; per user A = sum a^2, B = sum a e_r;
* items: a = x_r[c] per row;      per app  A = sum a^2, B = sum a e_r;
* new = old - (B + lambda * sign(old)) / A where B != 0, else old.

All users move at once, then the items against the new users. Terms with
weight 0 add nothing to p, A or B and are dropped up front, so the term table
is rows + positive neighbour links. Factor tables are (id, f0..f{d-1}); the
steps below state one pass each as joins and ``groupBy`` sums. Cross-validation
takes them for all folds and ranks together: one task a model where rows and
terms fit into one (``exposure_whole``), else on the blocks of ``exposure_blocks``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitnet.functions.vectors import sign
from habitnet.operators import blocks as bl
from habitnet.operators import exposure_blocks as eb
from habitnet.operators import exposure_whole as ew
from habitnet.operators.factors import fnames, init_factors
from habitnet.session import cut_compact, cut_lineage, partition_count

ROW = ["i", "j", "t"]


def exposure_terms(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(i, j, t, user, w) with zero-weight terms dropped."""
    # a window, not a join with counts: links that lie by (i, j), as ``exposure_long`` leaves them, are read once and not moved
    n = F.count(F.lit(1)).over(Window.partitionBy(*ROW))
    own = rows.select(*ROW, F.col("i").alias("user"), F.col("m0").cast("double").alias("w"))
    nb = (
        links.select(*ROW, "l", "ml0", n.alias("_n"))
        .where((F.col("ml0") != 0) & F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("t").isNotNull())
        .select(*ROW, F.col("l").alias("user"), (F.col("ml0").cast("double") / F.greatest(F.col("_n"), F.lit(1))).alias("w"))
    )
    return own.unionByName(nb).where(F.col("w") != 0)


def prepare(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Checkpoint once, then cache hash-partitioned by a unique key.

    Rows are keyed by (i, j, t); terms by (i, j, t, user), so the many terms
    of a hub's rows spread over all tasks and the per-row sums are combined
    map-side before their shuffle. Row-level results then meet the cached
    rows on (i, j, t) without moving them.
    """
    base = cut_lineage(df)
    n = partition_count(df.sparkSession, base.count())
    out = base.repartition(n, *(keys or ROW)).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def row_vectors(terms: DataFrame, U: DataFrame, d: int) -> DataFrame:
    """x_r per row: sum over terms of w * u_user."""
    u = U.select(F.col("id").alias("user"), *fnames(d))
    j = terms.join(u, "user")
    return j.groupBy(*ROW).agg(*[F.sum(F.col("w") * F.col(f"f{c}")).alias(f"x{c}") for c in range(d)])


def predictions(rows: DataFrame, terms: DataFrame, U: DataFrame, V: DataFrame, d: int) -> DataFrame:
    """(i, j, t, m1, x0.., p, e) for every row (rows without terms predict 0)."""
    x = row_vectors(terms, U, d)
    v = V.select(F.col("id").alias("j"), *[F.col(f"f{c}").alias(f"v{c}") for c in range(d)])
    out = rows.select(*ROW, "m1").join(x, ROW, "left").join(v, "j", "left")
    xs = [F.coalesce(F.col(f"x{c}"), F.lit(0.0)) for c in range(d)]
    p = xs[0] * F.col("v0")
    for c in range(1, d):
        p = p + xs[c] * F.col(f"v{c}")
    return out.select(*ROW, "m1", *[xs[c].alias(f"x{c}") for c in range(d)], *[f"v{c}" for c in range(d)], p.alias("p")).withColumn(
        "e", F.col("p") - F.col("m1")
    )


def rmse(rows: DataFrame, terms: DataFrame, U: DataFrame, V: DataFrame, d: int) -> DataFrame:
    """One row with the root mean squared error."""
    return predictions(rows, terms, U, V, d).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def _newton_update(F0: DataFrame, stats: DataFrame, c: int, lam: float) -> DataFrame:
    j = F0.join(stats, "id", "left")
    old = F.col(f"f{c}")
    upd = F.when(
        F.col("_B").isNotNull() & (F.col("_B") != 0) & (F.col("_A") > 0),
        old - (F.col("_B") + F.lit(lam) * sign(old)) / F.col("_A"),
    ).otherwise(old)
    cols = [upd.alias(n) if n == f"f{c}" else F.col(n) for n in fnames(len([x for x in F0.columns if x != "id"]))]
    return j.select("id", *cols)


def newton_user_step(rows: DataFrame, terms: DataFrame, U: DataFrame, V: DataFrame, d: int, c: int, lam: float) -> DataFrame:
    """One Newton coordinate step on every user at coordinate ``c``."""
    pr = predictions(rows, terms, U, V, d).select(*ROW, "e", F.col(f"v{c}").alias("_vc"))
    a = F.col("w") * F.col("_vc")
    stats = terms.join(pr, ROW).groupBy(F.col("user").alias("id")).agg(
        F.sum(a * a).alias("_A"), F.sum(a * F.col("e")).alias("_B")
    )
    return _newton_update(U, stats, c, lam)


def newton_item_step(rows: DataFrame, terms: DataFrame, U: DataFrame, V: DataFrame, d: int, c: int, lam: float) -> DataFrame:
    """One Newton coordinate step on every app at coordinate ``c``."""
    pr = predictions(rows, terms, U, V, d)
    a = F.col(f"x{c}")
    stats = pr.groupBy(F.col("j").alias("id")).agg(F.sum(a * a).alias("_A"), F.sum(a * F.col("e")).alias("_B"))
    return _newton_update(V, stats, c, lam)


def _gd_update(F0: DataFrame, grad: DataFrame, c: int, rate: float, lam: float, n_rows: int) -> DataFrame:
    j = F0.join(grad, "id", "left")
    old = F.col(f"f{c}")
    upd = F.when(F.col("_g").isNotNull(), old - F.lit(rate) * (F.col("_g") / F.lit(float(n_rows)) + F.lit(lam) * sign(old))).otherwise(old)
    d = len([x for x in F0.columns if x != "id"])
    return j.select("id", *[upd.alias(n) if n == f"f{c}" else F.col(n) for n in fnames(d)])


def gd_user_step(rows: DataFrame, terms: DataFrame, U: DataFrame, V: DataFrame, d: int, c: int, rate: float, lam: float, n_rows: int,
                     preds: DataFrame | None = None) -> DataFrame:
    """First-order step on users: g = sum e_r * w * v_j[c] / n_rows."""
    pr = predictions(rows, terms, U, V, d).select(*ROW, "e", F.col(f"v{c}").alias("_vc"))
    g = terms.join(pr, ROW).groupBy(F.col("user").alias("id")).agg(F.sum(F.col("e") * F.col("w") * F.col("_vc")).alias("_g"))
    return _gd_update(U, g, c, rate, lam, n_rows)


def gd_item_step(rows: DataFrame, terms: DataFrame, U: DataFrame, V: DataFrame, d: int, c: int, rate: float, lam: float, n_rows: int,
                     salts: DataFrame | None = None) -> DataFrame:
    """First-order step on apps: g = sum e_r * x_r[c] / n_rows."""
    pr = predictions(rows, terms, U, V, d)
    g = pr.groupBy(F.col("j").alias("id")).agg(F.sum(F.col("e") * F.col(f"x{c}")).alias("_g"))
    return _gd_update(V, g, c, rate, lam, n_rows)


def next_coordinate(d: int, last: int, seed: int, fold: int, epoch: int) -> int:
    """A seeded coordinate different from ``last`` (always 0 when d == 1)."""
    if d == 1:
        return 0
    h = int(hashlib.md5(f"{seed}#{fold}#{epoch}".encode()).hexdigest()[:8], 16)
    c = h % (d - 1) if last >= 0 else h % d
    return c + 1 if 0 <= last <= c else c


def model_factors(rows: DataFrame, d: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """M13 for the model: unit vectors for the row owners and the apps."""
    U = init_factors(rows, "i", d, seed, "eu")
    V = init_factors(rows, "j", d, seed, "ev")
    return U, V


def _factors_of_ranks(rows: DataFrame, key: str, ranks: list[int], seed: int, role: str) -> DataFrame:
    """``init_factors`` of every rank d as columns ``r{d}_{c}``."""
    out = None
    for d in ranks:
        own = init_factors(rows, key, d, seed, role).withColumnsRenamed({f"f{c}": f"r{d}_{c}" for c in range(d)})
        out = own if out is None else out.join(own, "id")
    return out


MAX_COLUMNS = 512  # factor columns of the models that train together
MAX_FOLDS = 62  # bits of a day's fold mask
WINDOW_EPOCHS = 7  # epochs of one Spark job; lineage is cut after each


def _until_stop(losses: list[float], stop_ratio: float) -> int:
    """How many epochs count: up to the first that reaches ``stop_ratio`` times the best without bettering it."""
    best = math.inf
    for n, v in enumerate(losses, 1):
        if v < best:
            best = v
        elif v >= stop_ratio * best:
            return n
    return len(losses)


def _train_models(found: eb.Problem, layout: eb.Layout, first: DataFrame, max_epochs: int, stop_ratio: float, seed: int,
                  lu: float, lv: float, rate: float | None, train_rows: np.ndarray | None, window: int) -> np.ndarray:
    """Errors by epoch: (epochs, 4, models) of sum and count of train squares, then of valid ones."""
    last = [-1] * len(layout.models)
    state, log = first, []
    opening = [(found.blocks, eb.moved(None, layout.begins, 0.0, layout.width, "uv")), (found.tiles, eb.sums_for_rows(layout.width))]
    for begin in range(0, max_epochs, window):
        plan, opening = opening, []
        for epoch in range(begin, min(begin + window, max_epochs)):
            if epoch == max_epochs - 1:  # its step is not looked at
                plan.append((found.rows, eb.errors(layout, None, fresh=epoch == begin)))
                break
            last = [next_coordinate(d, c, seed, layout.base + fold, epoch) for (d, fold), c in zip(layout.models, last)]
            columns = layout.begins + np.array(last)
            plan += [
                (found.rows, eb.errors(layout, columns, fresh=epoch == begin)),
                (found.tiles, eb.user_sums(len(layout.models))),
                (found.blocks, eb.moved("u", columns, lu, layout.width, "u", rate, train_rows)),
                (found.tiles, eb.sums_for_rows(layout.width)),
                (found.rows, eb.app_sums(layout, columns)),
                (found.blocks, eb.moved("v", columns, lv, layout.width, "v", rate, train_rows)),
            ]
        state = bl.advanced(state, plan, found.parts)
        log.append(bl.summed_logs(state).reshape(-1, 4, len(layout.models)))
        so_far = np.concatenate(log)
        if all(_until_stop(v, stop_ratio) < len(v) for v in np.transpose(_rmse_of(so_far[:, 2:])).tolist()):
            break
    return np.concatenate(log)


def _train_whole(rows: DataFrame, terms: DataFrame, bits: DataFrame, ranks: list[int], n_folds: int, base: int, max_epochs: int, stop_ratio: float,
                 seed: int, lu: float, lv: float, rate: float | None, n_train: dict[int, int]) -> dict[tuple[int, int], np.ndarray]:
    """Errors by epoch, (epochs, 4), of each (rank, fold - base): a task a model."""
    rows = cut_lineage(rows.select(*ROW, "m1"))
    users, apps = bl.indexed(rows, "i", 1), bl.indexed(rows, "j", 1)
    problem, found = ew.packed(rows, terms, bits, users, apps), {}
    stops = lambda seen: _until_stop([*seen, -math.inf], stop_ratio) == len(seen)
    for d in ranks:
        first = [
            bl.initial_state(init_factors(rows, key, d, seed, role), index, key, F.lit(0).cast("long"), fnames(d)).select(F.col("numbers").alias(name))
            for index, key, role, name in ((users, "i", "eu", "u"), (apps, "j", "ev", "v"))
        ]
        coordinates = {}
        for fold in range(n_folds):
            own = [-1]
            for epoch in range(max_epochs - 1):  # the last epoch's step is not looked at
                own.append(next_coordinate(d, own[-1], seed, base + fold, epoch))
            coordinates[fold] = own[1:]
        of_fold = ew.errors_of_folds(problem, cut_lineage(first[0].join(first[1])), d, coordinates, lu, lv, rate, n_train, stops)
        found |= {(d, fold): errors for fold, errors in of_fold.items()}
    return found


def _rmse_of(parts: np.ndarray) -> np.ndarray:
    """sqrt(sum / count), infinite where nothing is counted."""
    total, n = parts[:, 0], parts[:, 1]
    return np.where(n > 0, np.sqrt(total / np.maximum(n, 1)), np.inf)


def cross_validate_ranks(rows: DataFrame, links: DataFrame, folds_days: DataFrame, ranks: Iterable[int] = (7,), max_epochs: int = 21,
                         seed: int = 42, lam: float = 1e-4, solver: str = "newton", rate: float = 0.5, stop_ratio: float = 1.01,
                         tile_rows: int = bl.TILE_ROWS, place_rows: int | None = None,
                         window: int = WINDOW_EPOCHS, whole_terms: int = ew.WHOLE_TERMS) -> tuple[DataFrame, list[dict]]:
    """Repeated day hold-out of a model per (rank, fold), all in the same passes.

    ``folds_days`` is (fold, day, is_train) from ``holdout_days``. Returns a
    frame (rank, fold, best_rmse) and the epoch log. An epoch moves one
    coordinate per model; the best validation RMSE counts, up to the epoch that
    reaches ``stop_ratio`` times it. With up to ``whole_terms`` terms each model is trained by one task (``exposure_whole``),
    unless smaller tiles or places are asked for. Else terms are laid out once, whatever the
    number of models (``exposure_blocks``); jobs grow with epochs only, as long
    as the models' factors have ``MAX_COLUMNS`` columns together.
    """
    if solver not in ("newton", "gd"):
        raise ValueError(f"solver must be 'newton' or 'gd', not {solver!r}")
    spark, ranks = rows.sparkSession, sorted(set(ranks))
    rows = cut_lineage(rows.select(*ROW, "m0", "m1"))
    terms = cut_compact(exposure_terms(rows, links))
    whole = tile_rows >= bl.TILE_ROWS and place_rows is None and 0 < terms.count() <= whole_terms and rows.count() * max(ranks) <= ew.WHOLE_NUMBERS
    lu, lv = (lam * math.sqrt(rows.select(c).distinct().count()) for c in ("i", "j"))
    n_folds = 1 + (folds_days.agg(F.max("fold")).first()[0] if not rows.isEmpty() else -1)
    per_fold = {}
    if solver == "gd":
        of_days = rows.join(F.broadcast(folds_days.where("is_train").select("fold", F.col("day").alias("t"))), "t")  # one row per day and fold
        per_fold = {r["fold"]: r["count"] for r in of_days.groupBy("fold").count().collect()}
    scores, log = [], []

    def add(d: int, fold: int, train: np.ndarray, valid: np.ndarray) -> None:
        n = _until_stop(valid.tolist(), stop_ratio)
        seen = lambda x: float(x) if math.isfinite(x) else None
        log.extend({"rank": d, "fold": fold, "epoch": e, "train_rmse": seen(train[e]), "valid_rmse": seen(valid[e])} for e in range(n))
        scores.append((d, fold, float(valid[:n].min())))

    for base in range(0, n_folds, MAX_FOLDS):
        folds = range(base, min(base + MAX_FOLDS, n_folds))
        bits = eb.fold_bits(folds_days.where(F.col("fold").between(folds[0], folds[-1])).withColumn("fold", F.col("fold") - base))
        if whole:
            own = {f: per_fold.get(base + f, 0) for f in range(len(folds))}
            errors = _train_whole(rows, terms, bits, ranks, len(folds), base, max_epochs, stop_ratio, seed, lu, lv, rate if solver == "gd" else None, own)
            for d, f in itertools.product(ranks, range(len(folds))):
                add(d, base + f, *(_rmse_of(errors[d, f][:, k : k + 2]) for k in (0, 2)))
            continue
        groups: list[list[int]] = []
        for d in ranks:
            if groups and (sum(groups[-1]) + d) * len(folds) <= MAX_COLUMNS:
                groups[-1].append(d)
            else:
                groups.append([d])
        found = eb.problem(rows, terms, bits, max(map(sum, groups)) * len(folds), tile_rows, place_rows)
        for group in groups:
            layout = eb.Layout([(d, f) for d in group for f in range(len(folds))], base)
            names = [f"r{d}_{c}" for d, _ in layout.models for c in range(d)]
            first = None
            for index, key, place, role in ((found.users, "i", bl.left_place, "eu"), (found.apps, "j", bl.right_place, "ev")):
                own = bl.initial_state(_factors_of_ranks(rows, key, group, seed, role), index, key, place(F.col("block")), names)
                first = own if first is None else first.unionByName(own)
            trained = np.array([per_fold.get(base + f, 0) for _, f in layout.models]) if solver == "gd" else None
            errors = _train_models(found, layout, cut_lineage(first), max_epochs, stop_ratio, seed, lu, lv,
                                   rate if solver == "gd" else None, trained, window)
            train, valid = _rmse_of(errors[:, :2]), _rmse_of(errors[:, 2:])
            for k, (d, f) in enumerate(layout.models):
                add(d, base + f, train[:, k], valid[:, k])
        found.free()
    return spark.createDataFrame(scores, "rank int, fold int, best_rmse double"), log


def cross_validate(rows: DataFrame, links: DataFrame, folds_days: DataFrame, d: int = 7, max_epochs: int = 21,
                   seed: int = 42, lam: float = 1e-4, solver: str = "newton", rate: float = 0.5, **sizes) -> tuple[DataFrame, list[dict]]:
    """M25/A15 at one rank: (fold, best_rmse) and the epoch log; see :func:`cross_validate_ranks`."""
    scores, log = cross_validate_ranks(rows, links, folds_days, [d], max_epochs, seed, lam, solver, rate, **sizes)
    return scores.select("fold", "best_rmse"), log
