"""Logistic matrix factorisation with sampled negatives (M11..M17; F10, F11, A10, A12, A13, X3).

Factor tables are ``(id, f0..f{d-1})`` frames. One step is two passes over the
samples: user gradients at (U, V), then item gradients at (U', V), as
in the source model. ``lmf_step`` and its parts state one step as joins and
sums. ``train_lmf`` takes hundreds for several restarts: one task a restart where
its samples fit into one (``factor_whole``), else on the packed tiles of
``factor_blocks``: samples stay where they are, blocks of factor rows travel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitnet.functions.seeded import md5_int32, md5_key, md5_uniform
from habitnet.functions.vectors import dot_cols, log_loss, norm_cols, sigmoid
from habitnet.operators import blocks as bl
from habitnet.operators import factor_blocks as fb
from habitnet.operators import factor_whole as fw
from habitnet.operators.components import consecutive_index
from habitnet.session import cut_compact, cut_lineage, cut_round, free_shuffles, partition_count


def fnames(d: int, p: str = "f") -> list[str]:
    return [f"{p}{c}" for c in range(d)]


# ---- samples -------------------------------------------------------------------------------

def app_permutation(apps: DataFrame, seed: int, restarts: int = 1) -> DataFrame:
    """(restart, app, pos): for each restart all apps (A13) in an order seeded by seed + restart, pos = 0..N-1."""
    own = apps.select("app").distinct().withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    key = F.struct("restart", "app")
    order = F.concat_ws(
        "#",
        F.lpad(F.col("_key.restart").cast("string"), 6, "0"),
        md5_key(F.lit("perm"), F.col("_key.app"), F.lit(seed) + F.col("_key.restart")),
        F.col("_key.app").cast("string"),
    )
    placed = cut_lineage(consecutive_index(own.select(key.alias("_key")), "_key", "_nth", order=order))
    n = F.lit(placed.count() // restarts)
    return placed.select("_key.restart", "_key.app", (F.col("_nth") - F.col("_key.restart") * n).alias("pos"))


CYCLE_CHUNK = 65_536  # steps of a user's walk that one window ranks


def restart_negatives(pos: DataFrame, seed: int, restarts: int, cycle_chunk: int = CYCLE_CHUNK) -> DataFrame:
    """M11/X3 for every restart (seed + restart): (restart, user, app), for each user as many unused
    apps as used ones (all unused apps when there are fewer).

    Exact without a users x apps product: apps get one seeded random order
    (positions 0..N-1) and each user a seeded offset into it. A user with p
    used apps takes the first p unused apps walking the cycle from its offset.
    Among the next min(2p, N) positions at most p are used, so that window
    always holds the answer: the candidate table is at most twice the
    positive table.

    Unused apps are ranked in two levels: in chunks of the walk, which a window
    sorts, after the counts of the user's chunks before. A user with a third of
    all pairs is as many chunks, not one window.
    """
    pairs = cut_compact(pos.select("user", "app").distinct())  # read three times below
    perm = app_permutation(pairs.select("app"), seed, restarts)
    n = pairs.select("app").distinct().count()
    deg = pairs.groupBy("user").agg(F.count(F.lit(1)).alias("_p"))
    deg = deg.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    # the offset is hashed once per user and restart, before the window is exploded
    deg = deg.withColumn("_off", md5_int32(F.lit("offset"), F.col("user"), F.lit(seed) + F.col("restart")))
    cand = deg.select(
        "restart", "user", "_p", "_off",
        F.explode(F.sequence(F.lit(0), F.least(F.col("_p") * 2, F.lit(n)) - 1)).alias("_g"),
    ).withColumn("pos", F.pmod(F.col("_off") + F.col("_g"), F.lit(n)))
    free = cand.join(perm, ["restart", "pos"]).join(pairs, ["user", "app"], "left_anti")
    free = cut_compact(free.select("restart", "user", "app", "_p", "_g", F.floor(F.col("_g") / cycle_chunk).alias("_c")))
    free_shuffles(pos.sparkSession)  # else the files of the joins of all candidates stay on disk through what follows
    walk = ["restart", "user"]
    before = Window.partitionBy(*walk).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    chunks = free.groupBy(*walk, "_c").agg(F.count(F.lit(1)).alias("_n"))
    chunks = cut_lineage(chunks.select(*walk, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    rank = F.row_number().over(Window.partitionBy(*walk, "_c").orderBy("_g")) + F.col("_before")
    ranked = free.join(chunks, [*walk, "_c"]).withColumn("_rank", rank)
    return ranked.where(F.col("_rank") <= F.col("_p")).select(*walk, "app")


def negative_samples(pos: DataFrame, seed: int = 42) -> DataFrame:
    """M11/X3 for one seed: (user, app); see :func:`restart_negatives`."""
    return restart_negatives(pos, seed, 1).select("user", "app")


def training_samples(pos: DataFrame, seed: int = 42) -> DataFrame:
    """(user, app, r) with r = 1.0 for used and 0.0 for sampled pairs."""
    p = pos.select("user", "app").distinct()
    return p.withColumn("r", F.lit(1.0)).unionByName(negative_samples(p, seed).withColumn("r", F.lit(0.0)))


# ---- factors -------------------------------------------------------------------------------

def init_factors(ids: DataFrame, key: str, d: int, seed: int, role: str) -> DataFrame:
    """Coordinates uniform in [0, 1) from md5(role # id # c # seed), then
    scaled to a unit vector of absolute values (F5)."""
    raw = ids.select(F.col(key).alias("id")).distinct().select(
        "id", *[md5_uniform(F.lit(role), F.col("id"), F.lit(c), F.lit(seed)).alias(f"f{c}") for c in range(d)]
    )
    n = norm_cols([F.col(c) for c in fnames(d)])
    return raw.select("id", *[(F.abs(F.col(c)) / n).alias(c) for c in fnames(d)])


def _joined(samples: DataFrame, U: DataFrame, V: DataFrame, d: int) -> DataFrame:
    u = U.select(F.col("id").alias("user"), *[F.col(f"f{c}").alias(f"u{c}") for c in range(d)])
    v = V.select(F.col("id").alias("app"), *[F.col(f"f{c}").alias(f"v{c}") for c in range(d)])
    j = samples.join(u, "user")
    j = j.join(v, "app")
    p = dot_cols([F.col(f"u{c}") for c in range(d)], [F.col(f"v{c}") for c in range(d)])
    return j.withColumn("_p", p).withColumn("_g", sigmoid(F.col("_p")) - F.col("r"))


def losses(samples: DataFrame, U: DataFrame, V: DataFrame, d: int) -> DataFrame:
    """One row (train_loss over all samples, observed_loss over positives)."""
    j = _joined(samples, U, V, d).withColumn("_l", log_loss(F.col("r"), F.col("_p")))
    return j.agg(
        F.avg("_l").alias("train_loss"),
        F.avg(F.when(F.col("r") == 1.0, F.col("_l"))).alias("observed_loss"),
    )


def user_gradients(samples: DataFrame, U: DataFrame, V: DataFrame, d: int) -> DataFrame:
    """Sum over a user's samples of (s(u.v) - r) v."""
    j = _joined(samples, U, V, d)
    return j.groupBy(F.col("user").alias("id")).agg(*[F.sum(F.col("_g") * F.col(f"v{c}")).alias(f"g{c}") for c in range(d)])


def item_gradients(samples: DataFrame, U: DataFrame, V: DataFrame, d: int) -> DataFrame:
    """Sum over an app's samples of (s(u.v) - r) u."""
    j = _joined(samples, U, V, d)
    return j.groupBy(F.col("app").alias("id")).agg(*[F.sum(F.col("_g") * F.col(f"u{c}")).alias(f"g{c}") for c in range(d)])


def apply_gradient(F0: DataFrame, G: DataFrame, d: int, eta: float, lam: float) -> DataFrame:
    """x <- x - eta (g + lam x); ids without samples keep a zero gradient."""
    j = F0.join(G, "id", "left")
    return j.select("id", *[
        (F.col(f"f{c}") - F.lit(eta) * (F.coalesce(F.col(f"g{c}"), F.lit(0.0)) + F.lit(lam) * F.col(f"f{c}"))).alias(f"f{c}")
        for c in range(d)
    ])


def lmf_step(samples: DataFrame, U: DataFrame, V: DataFrame, d: int, eta: float, lu: float, lv: float) -> tuple[DataFrame, DataFrame]:
    """One full-batch step: users first, then items against the new users."""
    U1 = cut_lineage(apply_gradient(U, user_gradients(samples, U, V, d), d, eta, lu))  # read twice: returned and below
    V1 = apply_gradient(V, item_gradients(samples, U1, V, d), d, eta, lv)
    return U1, V1


@dataclass
class LmfResult:
    users: DataFrame
    items: DataFrame
    history: list[dict]
    best_restart: int
    best_loss: float


def prepare_samples(samples: DataFrame) -> DataFrame:
    """Write the samples to the checkpoint folder once, then cache them spread
    by their unique (user, app) key.

    Spreading by the pair, not by user, keeps a user who holds a third of all
    samples from landing in one task: per-user gradient sums are combined
    map-side in every partition and only partial sums are shuffled.
    Lost cache blocks are rebuilt from the checkpoint with one shuffle.
    """
    base = cut_compact(samples.select("user", "app", "r"))
    free_shuffles(samples.sparkSession)
    n = partition_count(samples.sparkSession, base.count())
    out = base.repartition(n, "user", "app").persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


WHOLE_SAMPLES = 16_000_000  # of a restart that one task trains: some 10 bytes each there
SAMPLE_TILE_ROWS = 2_000_000  # of a tile, where every core has several tiles
WINDOW_STEPS = 12  # steps of one Spark job; lineage is cut after each


def _followed(losses: list[float], stop_ratio: float) -> tuple[int, int]:
    """The step of the least loss until the stop, and the step that stopped (or the number of steps)."""
    best = 0
    for step, loss in enumerate(losses):
        if loss < losses[best] or not step:
            best = step
        elif loss > stop_ratio * losses[best]:
            return best, step
    return best, len(losses)


def train_lmf(pos: DataFrame, d: int = 5, rate: float = 1e-4, max_steps: int = 800, restarts: int = 6,
              stop_ratio: float = 1.001, monitor: str = "train", lam: float = 1e-4, seed: int = 42,
              tile_rows: int = bl.TILE_ROWS, window: int = WINDOW_STEPS, whole_samples: int = WHOLE_SAMPLES) -> LmfResult:
    """M15..M17: full-batch gradient descent on the logistic loss, all restarts in the same passes.

    Each restart draws new negatives (seed + restart), starts from the same
    initial factors and a fresh rate, decays the rate by 1/1.0001 per step,
    keeps the factors of the step with the least monitored loss and stops once the loss
    exceeds ``stop_ratio`` times the best. The restart with the least
    observed loss at its best step wins.

    A restart of up to ``whole_samples`` samples is trained by one task (``factor_whole``), unless tiles below the
    default size are asked for. Else samples and factors are blocks (``factor_blocks``); ``window`` steps are one
    job, after which only losses come back to the driver: whether a restart has
    stopped, and its best step, follow from these. Each restart remembers the
    checkpoint before its best step, and the winner's steps from there are
    taken again, so no snapshots are carried along.
    """
    if monitor not in ("train", "observed"):
        raise ValueError(f"monitor must be 'train' or 'observed', not {monitor!r}")
    p = cut_compact(pos.select("user", "app").where(F.col("user").isNotNull() & F.col("app").isNotNull()).distinct())
    n_pos, m, n = p.agg(F.count(F.lit(1)), F.count_distinct("user"), F.count_distinct("app")).first()
    lu, lv = lam * math.sqrt(m), lam * math.sqrt(n)
    if 2 * n_pos <= whole_samples and tile_rows >= bl.TILE_ROWS:
        return _train_whole(p, m, n, d, rate, max_steps, restarts, stop_ratio, monitor, lu, lv, seed)
    n_samples = 2 * n_pos * restarts
    # messages are each block's rows once for each of its tiles: the fewer tiles, the fewer
    tile_rows = max(tile_rows, min(SAMPLE_TILE_ROWS, n_samples // (4 * pos.sparkSession.sparkContext.defaultParallelism)))
    left, right = bl.grid(n_samples, m, n, tile_rows, max(bl.IDS_PER_BLOCK, bl.BLOCK_NUMBERS // (d * restarts)))
    users, apps = bl.indexed(p, "user", left), bl.indexed(p, "app", right)
    drawn = p.withColumns({"r": F.lit(1.0), "restart": F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))})
    samples = drawn.unionByName(restart_negatives(p, seed, restarts).withColumn("r", F.lit(0.0)))
    tiles = cut_lineage(fb.sample_tiles(samples, users, apps, right, restarts, tile_rows))
    free_shuffles(pos.sparkSession)
    parts = max(1, tiles.count())
    counts = {x["restart"]: x["n"] for x in samples_per_restart(tiles, restarts).collect()}  # one number per restart
    near = bl.dealt(cut_lineage(bl.tiles_of_blocks(tiles, {0: "u", 1: "v"})), parts)
    tiles = bl.dealt(tiles, parts)
    sides = ((users, "user", bl.left_place(F.col("block")), "u"), (apps, "app", bl.right_place(F.col("block")), "v"))
    first = None
    for index, key, place, role in sides:
        own = bl.initial_state(init_factors(p, key, d, seed, role), index, key, place, fnames(d) * restarts)
        first = own if first is None else first.unionByName(own)

    def advanced(state: DataFrame, at: int, steps: int, measure: bool = False) -> DataFrame:
        """``state`` (of step ``at``) after ``steps`` steps; ``measure``: with the last factors' losses too."""
        eta = rate
        for _ in range(at):
            eta /= 1.0001
        plan = [(near, fb.moved(None, eta, 0.0, d, fresh=True))]
        for _ in range(steps):
            plan += [
                (tiles, fb.gradients(0, d, restarts)), (near, fb.moved("u", eta, lu, d)),
                (tiles, fb.gradients(1, d, restarts)), (near, fb.moved("v", eta, lv, d)),
            ]
            eta /= 1.0001
        if measure:
            plan += [(tiles, fb.gradients(0, d, restarts)), (near, fb.moved(None, eta, 0.0, d))]
        return bl.advanced(state, plan, parts, roles=("S",))

    state, at = cut_lineage(first), 0
    train, observed = [[] for _ in range(restarts)], [[] for _ in range(restarts)]
    kept: dict[int, tuple[int, DataFrame]] = {}  # restart -> (step, state) at or before its best step
    while at < max_steps:
        last = at + window >= max_steps
        steps = max_steps - 1 - at if last else window
        after = advanced(state, at, steps, measure=last)
        log = bl.summed_logs(after).reshape(-1, 2, restarts)
        for rs in range(restarts):
            train[rs] += (log[:, 0, rs] / counts[rs]).tolist()
            observed[rs] += (log[:, 1, rs] / n_pos).tolist()
            best, _ = _followed((train if monitor == "train" else observed)[rs], stop_ratio)
            if best >= at:
                kept[rs] = (at, state)
        state, at = after, at + len(log)
        if all(_followed(x, stop_ratio)[1] < len(x) for x in (train if monitor == "train" else observed)):
            break
    history, (loss, winner, best) = _compared(train, observed, monitor, stop_ratio)
    begin, state = kept[winner]
    if best > begin:
        state = advanced(state, begin, best - begin)
    out = [cut_round(bl.unpacked(state, index, key, place, fnames(d), restarts, winner)) for index, key, place, _ in sides]
    for cached in (tiles, near):
        cached.unpersist()
    return LmfResult(out[0], out[1], history, winner, loss)


def _compared(train: list[list[float]], observed: list[list[float]], monitor: str, stop_ratio: float) -> tuple[list[dict], tuple[float, int, int]]:
    """The history of all restarts' losses, and the winner: (observed loss, restart, its best step)."""
    history, finals = [], []
    for rs in range(len(train)):
        best, stop = _followed((train if monitor == "train" else observed)[rs], stop_ratio)
        for step in range(min(stop + 1, len(train[rs]))):
            history.append({"restart": rs, "step": step, "train_loss": train[rs][step], "observed_loss": observed[rs][step]})
        history.append({"restart": rs, "step": -1, "train_loss": None, "observed_loss": observed[rs][best]})
        finals.append((observed[rs][best], rs, best))
    return history, min(finals)


def _packed_by(df: DataFrame, key: str, order: list[str], columns: dict[str, type], extra: int = 0) -> DataFrame:
    """One row per ``key``: ``columns`` as raw numbers, in ``order`` (the last of it first, as for ``lexsort``).

    A first column of ``extra`` > 0 ids is counted: how many rows each id from 0 to ``extra`` - 1 has.
    """

    def pack(rows: pa.Table) -> pa.Table:
        at = np.lexsort([rows.column(c).to_numpy() for c in order])
        out = [pa.array([rows.column(key)[0].as_py()], pa.int32())]
        for nth, (name, kind) in enumerate(columns.items()):
            x = rows.column(name).to_numpy()
            x = np.bincount(x, minlength=extra) if extra and not nth else x[at]
            out.append(pa.array([bl.raw(x, kind)], pa.binary()))
        return pa.table(out, [key, *columns])

    names = list(dict.fromkeys([key, *order, *columns]))
    return df.select(*names).groupBy(key).applyInArrow(pack, f"{key} int, " + ", ".join(f"{c} binary" for c in columns))


def _train_whole(p: DataFrame, m: int, n: int, d: int, rate: float, max_steps: int, restarts: int, stop_ratio: float, monitor: str,
                 lu: float, lv: float, seed: int) -> LmfResult:
    """``train_lmf`` of the distinct pairs ``p`` of ``m`` users and ``n`` apps, one task a restart."""
    every = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart")
    users, apps = bl.indexed(p, "user", 1), bl.indexed(p, "app", 1)
    u, a = users.select("user", F.col("nth").alias("ui")), apps.select("app", F.col("nth").alias("ai"))
    pairs = _packed_by(p.join(u, "user").join(a, "app").select(F.lit(0).alias("one"), "ui", "ai"), "one", ["ai", "ui"], {"ui": np.int32, "ai": np.int32}, m)
    start = u.select("ui", "user", every).select("restart", "ui", md5_int32(F.lit("offset"), F.col("user"), F.lit(seed) + F.col("restart")).alias("begin"))
    start = _packed_by(start.withColumn("begin", F.col("begin") % F.lit(n)), "restart", ["ui"], {"begin": np.int32})
    order = app_permutation(p.select("app"), seed, restarts).join(a, "app").select(F.col("restart").cast("int").alias("restart"), "pos", "ai")
    order = _packed_by(order.withColumnRenamed("ai", "walk"), "restart", ["pos"], {"walk": np.int32})
    first = [
        bl.initial_state(init_factors(p, key, d, seed, role), index, key, F.lit(0).cast("long"), fnames(d)).select(F.col("numbers").alias(role))
        for index, key, role in ((users, "user", "u"), (apps, "app", "v"))
    ]
    one = cut_lineage(pairs.drop("one").join(first[0]).join(first[1]))  # a row of each
    tasks = one.select("*", every).join(start, "restart").join(order, "restart").repartitionByRange(restarts, "restart")
    names = ("restart", "ui", "ai", "begin", "walk", "u", "v")

    def run(batches):
        for batch in batches:
            for task in batch.to_pylist():
                counts, used, begin, walk = (bl.integers(task[c]).astype(k) for c, k in zip(names[1:5], (np.int64, np.int32, np.int64, np.int64)))
                samples = fw.Samples([(1.0, counts, used), (0.0, *fw.drawn(counts, used, begin, walk))], d)
                U, V = (np.ascontiguousarray(bl.doubles(task[c], d).T) for c in "uv")
                U, V, *losses = fw.trained(samples, U, V, rate, max_steps, lu, lv, lambda x: _followed(x, stop_ratio), monitor)
                own = [2 * task["restart"], 2 * task["restart"] + 1]
                columns = [[0, 0], ["S", "S"], own, [bl.raw(x.T, np.float64) for x in (U, V)], [bl.raw(np.array(x), np.float64) for x in losses]]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["place", "role", "source", "numbers", "more"])

    found = cut_lineage(tasks.select(*names).mapInArrow(run, bl.MESSAGE))
    logs = {x["source"]: bl.doubles(x["more"]).tolist() for x in found.select("source", "more").collect()}  # one number per restart and step
    train, observed = ([logs[2 * rs + k] for rs in range(restarts)] for k in (0, 1))
    history, (loss, winner, _) = _compared(train, observed, monitor, stop_ratio)
    out = [
        cut_round(bl.unpacked(found.where(F.col("source") == 2 * winner + k), index, key, F.lit(0).cast("long"), fnames(d)))
        for k, (index, key) in enumerate(((users, "user"), (apps, "app")))
    ]
    return LmfResult(out[0], out[1], history, winner, loss)


def samples_per_restart(tiles: DataFrame, restarts: int) -> DataFrame:
    """(restart, n): how many samples of each restart the tiles hold."""

    def count(batches):
        total = np.zeros(restarts, np.int64)
        for batch in batches:
            for users in batch.column("a").to_pylist():
                total += np.bincount(bl.integers(users) % restarts, minlength=restarts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(restarts, dtype=np.int32)), pa.array(total)], ["restart", "n"])

    return tiles.select("a").mapInArrow(count, "restart int, n long").groupBy("restart").agg(F.sum("n").alias("n"))


def factors_as_arrays(F_: DataFrame, d: int) -> DataFrame:
    """(id, factor array<double>) for storage (S11) and the cosine kNN."""
    return F_.select("id", F.array(*[F.col(c) for c in fnames(d)]).alias("factor"))
