"""k-nearest-neighbour user graphs (M9, M10, T1, Q10; J5, F1, F2, P13).

Exact top-k without a cross join and without shuffling every pair that shares
an app. Ties break on score descending, then neighbour id ascending, a total
order, so results are exact and deterministic.

**Jaccard on app sets** follows the overlaps, through an inverted index:

1. users are hashed into blocks, as many as the expected overlaps need; a block
   gets its users' app lists and, once for each app that it uses, the list of
   all users of that app, and counts overlaps (``cogroup`` in numpy);
2. apps of more than ``hot_users`` users are *hot* and have no such lists. A
   pair's overlap lies between that in other apps and that plus the lesser
   number of hot apps, so candidates whose upper bound is below the k-th lower
   bound go, and the hot apps of the others are counted by joining their lists;
3. a pair that shares hot apps only scores at most (hot apps of the user) / (apps
   of the user). Users whose k-th score is above that are done. The others meet
   all users of hot apps in cells of a row block and a column block.

Where lists would be sent more than ``LISTED_PER_PAIR`` times as often as there
are pairs, none are: all apps are hot then, and all users meet in cells.

**Cosine** scores all pairs in such cells. A cell takes many more columns than
rows, since every cell of a row sends its ``k`` best. It goes over them in slabs:
near scores by a matrix product (Jaccard: exact overlaps, by the sets' bits or by
counting), of which only those that reach the row's k-th best so far are scored
exactly. All pairs are looked at, so time grows with the square of the users.

Both emit each user's top ``k`` of a group, and a ``row_number() <= k`` window
(a group limit) merges them. With ``fill=True`` users with fewer than ``k``
positive-score neighbours are completed with zero-score users in id order (the
source jobs fill every slot this way): among the ``k + 1`` least ids there are
always enough. ``fill=False`` keeps only positive scores. Rows without a user
or an app take no part.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitnet.session import cut_lineage

# The block-pair functions run in Python workers. Ship this module's code by
# value with them, so executors need numpy and pandas but not this package
# installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_BLOCK_SIZE = 16_384  # rows of a cell
COLUMN_BLOCKS = 4  # a cell's columns, in row blocks
COLUMN_NUMBERS = 1 << 22  # numbers of a cell's column vectors
MAX_CELL_TASKS = 2000
LISTED_PER_PAIR = 128
_PAIR_BUDGET = 1 << 22  # overlap pairs expanded at once inside a group
_SLAB = 1 << 19  # scores at once: they stay in a core's cache
_SLAB_COLUMNS = 8192
_BIT_SLAB = 1 << 17  # pairs whose bits are counted at once
_FIRST_COLUMNS = 2048  # the first bar is the k-th score among these
HOT_USERS = 4096  # an app of more users is hot
GROUP_OVERLAPS = 1 << 22  # overlaps that a block counts, on average


def _num_blocks(n_items: int, block_size: int, least: int = 1) -> int:
    return max(1, min(max(least, math.ceil(n_items / block_size)), n_items))


def _cells(rows: DataFrame, columns: DataFrame, key: str, n_rows: int, n_columns: int, block_size: int, column_size: int) -> DataFrame:
    """Rows (``_side`` 0) and columns (1) sent to the cells (``_gi``, ``_gj``) that they take part in, each cell whole in one task.

    The number of tasks is stated: a cell's work goes with rows x columns, not with the bytes by which AQE would merge tasks.
    """
    counts = [_num_blocks(n_rows, block_size, rows.sparkSession.sparkContext.defaultParallelism), _num_blocks(n_columns, column_size)]
    sides = []
    for side, (frame, names) in enumerate(((rows, ("_gi", "_gj")), (columns, ("_gj", "_gi")))):
        own = F.pmod(F.xxhash64(key), F.lit(counts[side])).cast("int").alias(names[0])
        other = F.explode(F.sequence(F.lit(0), F.lit(counts[1 - side] - 1))).alias(names[1])
        sides.append(frame.select("*", F.lit(side).alias("_side"), own, other).select(*frame.columns, "_side", "_gi", "_gj"))
    tasks = min(counts[0] * counts[1], MAX_CELL_TASKS)
    return sides[0].unionByName(sides[1]).repartition(tasks, "_gi", "_gj")


def _topk_rows(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise top-k of ``scores`` among ``valid`` entries; ties to the lower column.

    Columns are in ascending id order, so a stable sort on -score breaks ties
    by id. (A stable sort beats partition + tie repair here: Jaccard rows are
    mostly ties, which the sort handles in near-linear time.)
    """
    s = np.where(valid, scores, -np.inf)
    kk = min(k, s.shape[1])
    order = np.argsort(-s, axis=1, kind="stable")[:, :kk]
    rows = np.repeat(np.arange(s.shape[0]), kk)
    cols = order.ravel()
    keep = np.isfinite(s[rows, cols])
    return rows[keep], cols[keep]


def _best_first(r: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, column, score) by row, best first (ties to the lower column), ``k`` of each row."""
    order = np.lexsort((c, -score, r))
    r, c, score = r[order], c[order], score[order]
    kept = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
    return r[kept], c[kept], score[kept]


def _k_best(n_r: int, n_c: int, k: int, near, exact, itself: np.ndarray, floor: float, slack: float, wide: int) -> tuple[np.ndarray, ...]:
    """(row, column, score) of each row's ``k`` best columns, ties to the lower column.

    ``near(rows, columns)`` gives the scores of two slices, wrong by ``slack / 2`` at most and -inf or NaN where there is
    none; ``exact(rows, columns, r, c)`` those of some places of the slices. ``itself`` is each row's own column (or -1).
    What is below the row's k-th best so far less ``slack``, or below ``floor``, is not scored exactly.
    """
    wide = max(1, min(wide, n_c))
    tall = max(1, _SLAB // wide)
    out = []
    for r0 in range(0, n_r, tall):
        rows = slice(r0, min(r0 + tall, n_r))
        bar = np.full(rows.stop - r0, -np.inf)
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for c0 in range(0, n_c, wide):
            columns = slice(c0, min(c0 + wide, n_c))
            s = near(rows, columns)
            mine = itself[rows] - c0
            inside = np.flatnonzero((mine >= 0) & (mine < s.shape[1]))
            s[inside, mine[inside]] = -np.inf
            first = min(s.shape[1], _FIRST_COLUMNS)
            if c0 == 0 and k <= first:
                bar = np.partition(s[:, :first], first - k, axis=1)[:, first - k].astype("float64")
            low = np.maximum(bar - slack, floor).astype(s.dtype)
            r, c = np.divmod(np.flatnonzero((s >= low[:, None]).ravel()), s.shape[1])
            score = exact(rows, columns, r, c)
            good = np.isfinite(score)
            held = [np.concatenate([x, y[good]]) for x, y in zip(held, (r, c + c0, score))]
            if len(held[0]) > 32 * k * len(bar):
                held = list(_best_first(*held, k))
                full = np.bincount(held[0], minlength=len(bar)) == k
                bar[full] = np.maximum(bar[full], held[2][np.searchsorted(held[0], np.flatnonzero(full), "right") - 1])
        r, c, score = _best_first(*held, k)
        out.append((r + r0, c, score))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _counted_best(ca: np.ndarray, begin: np.ndarray, cb: np.ndarray, ib: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], k: int,
                  itself: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_k_best``, for rows whose overlaps are counted through the columns' inverted index: only those above 0 are scored."""
    n_c = len(sizes[1])
    users, ends = ib[np.argsort(cb, kind="stable")], np.cumsum(np.bincount(cb, minlength=1 + int(max(ca.max(), cb.max()))))
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    for row in range(len(begin) - 1):
        own = ca[begin[row]:begin[row + 1]]
        shared = np.bincount(np.concatenate([users[x:y] for x, y in zip(starts[own].tolist(), ends[own].tolist())]), minlength=n_c)
        if itself[row] >= 0:
            shared[itself[row]] = 0
        c = np.flatnonzero(shared)
        score = shared[c] / (sizes[0][row] + sizes[1][c] - shared[c]).astype("float64")
        if len(c) > k:
            high = score >= np.partition(score, len(c) - k)[len(c) - k]
            c, score = c[high], score[high]
        order = np.lexsort((c, -score))[:k]
        out.append((np.full(len(order), row), c[order], score[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bit_words(row: np.ndarray, app: np.ndarray, n_rows: int, n_apps: int) -> np.ndarray:
    """Sets as bits: words by rows, so that one word of all rows lies together."""
    words = -(-n_apps // 64)
    out = np.empty((words, n_rows), np.uint64)
    step = max(1, (1 << 24) // (64 * words))
    for begin in range(0, n_rows, step):
        end = min(begin + step, n_rows)
        at = slice(*np.searchsorted(row, (begin, end)))
        there = np.zeros((end - begin, 64 * words), np.uint8)
        there[row[at] - begin, app[at]] = 1
        out[:, begin:end] = np.packbits(there, axis=1, bitorder="little").view(np.uint64).T
    return out


def _bits_best(rows: np.ndarray, columns: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], n_apps: int, k: int, itself: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_k_best``, for rows and columns as ``_bit_words``: overlaps are bits counted, only those above 0 are scored.

    Columns are gone over by size. A row's k-th score so far and the least size of a slab tell the least overlap
    to look for, a small whole number; what has it is scored exactly.
    """
    n_r, n_c = rows.shape[1], columns.shape[1]
    by_size = np.argsort(sizes[1], kind="stable")
    columns, size_b = np.ascontiguousarray(columns[:, by_size]), sizes[1][by_size].astype(np.int64)
    size_a = sizes[0].astype(np.int64)
    mine = np.full(n_r, -1)
    place = np.empty(n_c, np.int64)
    place[by_size] = np.arange(n_c)
    mine[itself >= 0] = place[itself[itself >= 0]]
    kind = np.uint8 if n_apps < 1 << 8 else np.uint16 if n_apps < 1 << 16 else np.uint32
    most = np.iinfo(kind).max
    wide = min(n_c, _SLAB_COLUMNS)
    tall = max(1, _BIT_SLAB // wide)
    first = np.unique(np.linspace(0, n_c - 1, min(n_c, _FIRST_COLUMNS)).astype(np.int64))
    sampled, first_sizes = columns[:, first], size_b[first]
    space = np.empty(tall * max(wide, len(first)), np.uint64)
    ones = np.empty(len(space), np.uint8)

    def overlaps(x: slice, other: np.ndarray) -> np.ndarray:
        shape = (x.stop - x.start, other.shape[1])
        both, counted = (b[: shape[0] * shape[1]].reshape(shape) for b in (space, ones))
        total = np.zeros(shape, kind)
        for own, word in zip(rows, other):
            np.bitwise_and(own[x, None], word[None, :], out=both)
            np.bitwise_count(both, out=counted)
            total += counted
        return total

    out = []
    for r0 in range(0, n_r, tall):
        x = slice(r0, min(r0 + tall, n_r))
        bar = np.zeros(x.stop - x.start)
        if len(first) > k:
            ov = overlaps(x, sampled).astype(np.int64)
            s = ov / (size_a[x, None] + first_sizes[None, :] - ov)
            s[first[None, :] == mine[x, None]] = 0
            bar = np.partition(s, len(first) - k, axis=1)[:, len(first) - k]
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for c0 in range(0, n_c, wide):
            y = slice(c0, min(c0 + wide, n_c))
            ov = overlaps(x, columns[:, y])
            least = np.ceil(bar / (1 + bar) * (size_a[x] + size_b[c0]) - 1e-6 * size_a[x])
            r, c = np.divmod(np.flatnonzero(ov >= np.clip(least, 1, most).astype(kind)[:, None]), y.stop - y.start)
            shared = ov[r, c].astype(np.int64)
            score = shared / (size_a[x][r] + size_b[y][c] - shared).astype("float64")
            good = (score >= bar[r]) & (c + c0 != mine[x][r])
            held = [np.concatenate([a, b[good]]) for a, b in zip(held, (r, by_size[c + c0], score))]
            if len(held[0]) > 8 * k * len(bar):
                held = list(_best_first(*held, k))
                full = np.bincount(held[0], minlength=len(bar)) == k
                bar[full] = np.maximum(bar[full], held[2][np.searchsorted(held[0], np.flatnonzero(full), "right") - 1])
        r, c, score = _best_first(*held, k)
        out.append((r + r0, c, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def _unpack(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted user ids, row index per app entry, app per app entry) of a packed block."""
    block = block.sort_values("user", kind="stable")
    lists = block["apps"].to_list()
    lengths = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists))
    apps = np.concatenate([np.asarray(x) for x in lists]) if lists else np.empty(0)
    return block["user"].to_numpy(), np.repeat(np.arange(len(lists)), lengths), apps


def _none(ids: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"src": ids.iloc[:0], "dst": ids.iloc[:0], "score": pd.Series([], dtype="float64")})


def _jaccard_cell(k: int):
    """Top-k of the row users (``_side`` 0) among the column users (1) of one cell, positive scores only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = (pdf[pdf["_side"] == side] for side in (0, 1))
        if len(rows) == 0 or len(columns) == 0:  # a hash block may be empty
            return _none(pdf["user"])
        ua, ia, apps_a = _unpack(rows)
        ub, ib, apps_b = _unpack(columns)
        apps, codes = np.unique(np.concatenate([apps_a, apps_b]), return_inverse=True)
        ca, cb = codes[: len(apps_a)], codes[len(apps_a):]
        n_r, n_c, n_a = len(ua), len(ub), len(apps)
        size_a, size_b = np.bincount(ia, minlength=n_r), np.bincount(ib, minlength=n_c)
        begin = np.concatenate([[0], np.cumsum(size_a)])
        counted = float(np.bincount(ca, minlength=n_a) @ np.bincount(cb, minlength=n_a)) / (n_r * n_c)  # overlaps of a pair
        place = {u: n for n, u in enumerate(ub)}
        itself = np.array([place.get(u, -1) for u in ua], np.int64)
        # an app's bit costs about a hundredth of a counted overlap
        if n_a > 100 * (1 + counted) or (n_r + n_c) * n_a > 1 << 30:
            r, c, score = _counted_best(ca, begin, cb, ib, (size_a, size_b), k, itself)
        else:
            bits = _bit_words(ia, ca, n_r, n_a), _bit_words(ib, cb, n_c, n_a)
            r, c, score = _bits_best(*bits, (size_a, size_b), n_a, k, itself)
        return pd.DataFrame({"src": ua[r], "dst": ub[c], "score": score})

    return run


def _listed_overlaps(k: int):
    """Of the users of a block, with the user lists of the apps that they use: candidates (src, dst, shared, total).

    ``shared`` counts the listed apps, ``total`` is the sum of both users' apps. Candidates whose best possible
    score, with all hot apps of either shared, is below the k-th certain one are left out.
    """

    def run(rows: pa.Table, lists: pa.Table) -> pa.Table:
        kind = rows.schema.field("user").type
        out = [[], [], [], []]
        if rows.num_rows and lists.num_rows:
            entries, of_n, of_h = (lists.column(c).combine_chunks() for c in ("users", "n", "h"))
            many = entries.value_lengths().to_numpy()
            begin = np.cumsum(many) - many
            users, code = np.unique(entries.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            n, h = np.zeros(len(users), np.int64), np.zeros(len(users), np.int64)
            n[code], h[code] = of_n.flatten().to_numpy(), of_h.flatten().to_numpy()
            own = rows.column("user").combine_chunks()
            ids, own_n, own_h = own.to_numpy(zero_copy_only=False), *(rows.column(c).to_numpy() for c in "nh")
            cold = rows.column("cold").combine_chunks()
            at = pc.index_in(cold.flatten(), value_set=lists.column("app").combine_chunks()).to_numpy()
            row = np.repeat(np.arange(len(ids)), cold.value_lengths().to_numpy())
            upto = np.cumsum(many[at])  # overlaps to count
            cut = 0
            while cut < len(row):
                end = max(int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + _PAIR_BUDGET, "right")), cut + 1)
                end = int(np.searchsorted(row, row[end - 1], "right"))  # whole rows
                times = many[at[cut:end]]
                inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                other = code[np.repeat(begin[at[cut:end]], times) + inside]
                key, shared = np.unique(np.repeat(row[cut:end], times) * len(users) + other, return_counts=True)
                r, v = key // len(users), key % len(users)
                there = users[v] != ids[r]
                r, v, shared = r[there], v[there], shared[there]
                total = own_n[r] + n[v]
                low = shared / (total - shared)
                best = shared + np.minimum(own_h[r], h[v])
                order = np.lexsort((-low, r))  # stable, and v ascends already
                r, v, shared, total, low, best = (x[order] for x in (r, v, shared, total, low, best))
                first = np.searchsorted(r, r, "left")
                place = np.arange(len(r)) - first
                sure = np.minimum(first + k - 1, len(r) - 1)
                bar = np.where(r[sure] == r, low[sure], -1.0) if len(r) else low
                bar = np.where(first + k <= len(r), bar, -1.0)
                keep = (place < k) | ((best > shared) & (best / (total - best) >= bar))
                for held, x in zip(out, (ids[r[keep]], users[v[keep]], shared[keep], total[keep])):
                    held.append(x)
                cut = end
        columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        kinds = (kind, kind, pa.int64(), pa.int64())
        return pa.table([pa.array(c.tolist() if t == kind else c, t) for c, t in zip(columns, kinds)], ["src", "dst", "shared", "total"])

    return run


def _cosines(xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``xa`` with all rows of ``xb``; 0 where either is a zero vector.

    Products are added up coordinate by coordinate. A blocked matmul adds them
    in an order that follows the block's shape, and its last bits would then
    decide between equal vectors before their ids do.
    """
    dot, na, nb = np.zeros((len(xa), len(xb))), np.zeros(len(xa)), np.zeros(len(xb))
    for c in range(xa.shape[1]):
        a, b = xa[:, c], xb[:, c]
        dot += a[:, None] * b[None, :]
        na += a * a
        nb += b * b
    scale = np.sqrt(na)[:, None] * np.sqrt(nb)[None, :]
    return np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)


def _cosine_cell(k: int, fill: bool):
    """Top-k of the row vectors (``_side`` 0) among the column vectors (1) of one cell; ``_row`` tells a vector from itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["_side"] == side].sort_values("id", kind="stable") for side in (0, 1))
        if len(a) == 0 or len(b) == 0:  # a hash block may be empty
            return _none(pdf["id"])
        xa, xb = (np.vstack(x["vec"].to_numpy()).astype("float64") for x in (a, b))
        na, nb = np.zeros(len(xa)), np.zeros(len(xb))
        for c in range(xa.shape[1]):  # as in _cosines
            na += xa[:, c] * xa[:, c]
            nb += xb[:, c] * xb[:, c]
        norm_a, norm_b = np.sqrt(na), np.sqrt(nb)
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        by_row = np.argsort(b["_row"].to_numpy())
        own = b["_row"].to_numpy()[by_row]
        at = np.minimum(np.searchsorted(own, a["_row"].to_numpy()), len(own) - 1)
        itself = np.where(own[at] == a["_row"].to_numpy(), by_row[at], -1)
        plain = all(((x == 0) | ((x > 1e-100) & (x < 1e100))).all() for x in (norm_a, norm_b))
        if plain:
            unit = lambda x, n: np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0).astype(np.float32)
            ua, ub = unit(xa, norm_a), unit(xb, norm_b)
            # single precision is wrong by (width + 4) 2^-24 at most, on either side of a bar
            near, slack, wide = lambda x, y: ua[x] @ ub[y].T, 2e-7 * (xa.shape[1] + 16), _SLAB_COLUMNS
        else:  # products may overflow or vanish: all scores exactly
            near, slack, wide = lambda x, y: _cosines(xa[x], xb[y]), 0.0, _SLAB_COLUMNS

        def exact(x, y, r, c):
            dot = np.zeros(len(r))
            for n in range(xa.shape[1]):
                dot += xa[x, n][r] * xb[y, n][c]
            scale = norm_a[x][r] * norm_b[y][c]
            score = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
            return score if fill else np.where(score > 0, score, np.nan)

        def finite(x, y):
            s = near(x, y)
            return s if plain else np.where(np.isfinite(s), s, -np.inf)

        r, c, score = _k_best(len(ia), len(ib), k, finite, exact, itself, -np.inf if fill else -slack, slack, wide)
        return pd.DataFrame({"src": ia[r], "dst": ib[c], "score": score})

    return run


def _merge_topk(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.col("score").desc(), F.col("dst").asc())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks_and_lists(packed: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Users with their block, and for each block the user lists (``hot_users`` entries at most) of the apps used there."""
    blocked = packed.select(F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int").alias("_b"), "user", "n", "h", "cold")
    by_app = packed.select(F.explode("cold").alias("app"), F.struct("user", "n", "h").alias("x")).groupBy("app").agg(F.collect_list("x").alias("x"))
    # an array of each field: one of structs has three times the bytes
    by_app = by_app.select("app", F.col("x.user").alias("users"), *(F.col(f"x.{c}").cast("array<int>").alias(c) for c in "nh"))
    wanted = blocked.select(F.col("_b").alias("_block"), F.explode("cold").alias("app")).distinct()
    return blocked, wanted.join(by_app, "app")


def _jaccard_cells(rows: DataFrame, columns: DataFrame, k: int, block_size: int, utype: str) -> DataFrame:
    """Positive top-k of the users of ``rows`` among those of ``columns``, (user, apps) frames, cell by cell."""
    rows, columns = (x.select("user", "apps") for x in (rows, columns))
    cells = _cells(rows, columns, "user", rows.count(), columns.count(), block_size, COLUMN_BLOCKS * block_size)
    return cells.groupBy("_gi", "_gj").applyInPandas(_jaccard_cell(k), schema=f"src {utype}, dst {utype}, score double")


def _listed_scores(packed: DataFrame, k: int, block_size: int, blocks: int, any_hot: bool, utype: str) -> DataFrame:
    """Positive scores, among them every user's ``k`` best: by the user lists of all apps that are not hot, then by hot apps."""
    blocks = max(packed.sparkSession.sparkContext.defaultParallelism, blocks)
    blocked, lists = _blocks_and_lists(packed, blocks)
    found = blocked.groupBy("_b").cogroup(lists.groupBy("_block")).applyInArrow(
        _listed_overlaps(k), f"src {utype}, dst {utype}, shared long, total long")
    if not any_hot:
        return found.withColumn("score", F.col("shared") / (F.col("total") - F.col("shared"))).select("src", "dst", "score")
    apps = packed.select(F.col("user").alias("_u"), "hot")
    both = found.join(apps.toDF("src", "_a"), "src").join(apps.toDF("dst", "_c"), "dst")
    shared = F.col("shared") + F.size(F.array_intersect("_a", "_c"))
    scored = both.withColumn("shared", shared).withColumn("score", F.col("shared") / (F.col("total") - F.col("shared"))).select("src", "dst", "score")
    scored = cut_lineage(_merge_topk(scored, k).drop("rank"))
    least_score = scored.groupBy(F.col("src").alias("user")).agg(F.count(F.lit(1)).alias("_m"), F.min("score").alias("_kth"))
    users = packed.where("h > 0").join(least_score, "user", "left").select("user", "n", "h", F.concat("cold", "hot").alias("apps"), "_m", "_kth")
    # sharing hot apps only gives h / n at most; an equal score may still win by its id
    rest = users.where(F.col("_m").isNull() | (F.col("_m") < k) | (F.col("_kth") <= F.col("h") / F.col("n")))
    columns = packed.where("h > 0").select("user", F.concat("cold", "hot").alias("apps"))
    return scored.unionByName(_jaccard_cells(rest.select("user", "apps"), columns, k, block_size, utype)).distinct()


def jaccard_topk(usage: DataFrame, k: int, fill: bool = True, user: str = "user", app: str = "app", block_size: int = DEFAULT_BLOCK_SIZE,
                 hot_users: int = HOT_USERS, group_overlaps: int = GROUP_OVERLAPS) -> DataFrame:
    """M9 scores: (src, dst, score, rank) -- each user's ``k`` most Jaccard-similar users."""
    spark = usage.sparkSession
    own = usage.select(F.col(user).alias("user"), F.col(app).alias("app"))
    # written once: the input plan (often a large join) then runs a single time
    pairs = cut_lineage(own.where(F.col("user").isNotNull() & F.col("app").isNotNull()).distinct())
    utype = pairs.schema["user"].dataType.simpleString()
    # an app's code is shorter than most apps and tells them apart; the checkpoint keeps it
    counts = cut_lineage(pairs.groupBy("app").agg(F.count(F.lit(1)).alias("f")).withColumn("code", F.monotonically_increasing_id()))
    is_hot = F.col("f") > hot_users
    work = counts.agg(
        F.count_if(is_hot).alias("hot"), F.sum(F.when(~is_hot, F.col("f") * F.col("f"))).alias("overlaps"), F.sum(F.when(~is_hot, F.col("f"))).alias("listed")
    ).first()
    all_hot = (work["overlaps"] or 0) > LISTED_PER_PAIR * (work["listed"] or 0) or (work["hot"] and not work["overlaps"])
    if all_hot or work["hot"]:
        coded = pairs.join(counts.select("app", (F.lit(True) if all_hot else is_hot).alias("is_hot"), "code"), "app")
        tagged = coded.select("user", F.when(~F.col("is_hot"), F.col("code")).alias("cold"), F.when(F.col("is_hot"), F.col("code")).alias("hot"))
    else:
        tagged = pairs.select("user", F.col("app").alias("cold"), F.lit(None).cast("long").alias("hot"))
    packed = cut_lineage(tagged.groupBy("user").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.count("hot").cast("int").alias("h"), F.collect_list("cold").alias("cold"), F.collect_list("hot").alias("hot"),
    ))
    least = [r["user"] for r in packed.select("user").orderBy("user").limit(k + 1).collect()]  # k + 1 ids
    if len(least) < 2:
        return spark.createDataFrame([], f"src {utype}, dst {utype}, score double, rank int")
    if all_hot:
        users = packed.select("user", F.col("hot").alias("apps"))
        scored = _jaccard_cells(users, users, k, block_size, utype)
    else:
        scored = _listed_scores(packed, k, block_size, math.ceil((work["overlaps"] or 0) / group_overlaps), bool(work["hot"]), utype)
    if fill:
        scored = cut_lineage(_merge_topk(scored, k).drop("rank"))
        done = scored.groupBy(F.col("src").alias("user")).agg(F.count(F.lit(1)).alias("_m"))
        short = packed.select("user").join(done, "user", "left").where(F.col("_m").isNull() | (F.col("_m") < k))
        ids = F.array(*map(F.lit, least)).cast(f"array<{utype}>")
        zero = short.select(F.col("user").alias("src"), F.explode(ids).alias("dst"), F.lit(0.0).alias("score")).where(F.col("src") != F.col("dst"))
        scored = scored.unionByName(zero.join(scored.select("src", "dst"), ["src", "dst"], "left_anti"))
    return _merge_topk(scored, k)


def cosine_topk(vectors: DataFrame, k: int, fill: bool = True, key: str = "id", vec: str = "vec", block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """M10 scores: (src, dst, score, rank) by cosine of dense vectors (true L2 norms)."""
    items = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    items = cut_lineage(items.withColumn("_row", F.monotonically_increasing_id()))  # ids may repeat
    ktype = items.schema["id"].dataType.simpleString()
    n, width = items.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n < 2:
        return items.sparkSession.createDataFrame([], f"src {ktype}, dst {ktype}, score double, rank int")
    column_size = max(block_size, min(16 * block_size, COLUMN_NUMBERS // max(width, 1)))
    cells = _cells(items, items, "_row", n, n, block_size, column_size)
    cands = cells.groupBy("_gi", "_gj").applyInPandas(_cosine_cell(k, fill), schema=f"src {ktype}, dst {ktype}, score double")
    return _merge_topk(cands, k)


def symmetrize(topk: DataFrame) -> DataFrame:
    """M9/M10 graph: kNN edges in both directions, distinct, no self pairs."""
    e = topk.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def direct_graph(usage: DataFrame, k: int, fill: bool = True, **kw) -> DataFrame:
    """M9: symmetrised Jaccard kNN graph."""
    return symmetrize(jaccard_topk(usage, k, fill, **kw))


def improved_graph(factors: DataFrame, k: int, fill: bool = True, key: str = "id", vec: str = "factor", **kw) -> DataFrame:
    """Symmetrised cosine kNN graph on latent factors."""
    return symmetrize(cosine_topk(factors, k, fill, key=key, vec=vec, **kw))
