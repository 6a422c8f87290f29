import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from habitnet.operators import knn


def test_topk_rows_exact_order():
    # scores 5,1,2,3 with k = 3 must give 5,3,2
    r, c = knn._topk_rows(np.array([[5.0, 1.0, 2.0, 3.0]]), np.ones((1, 4), bool), 3)
    assert sorted(c) == [0, 2, 3]
    # ties at the k-th value go to the lower column (smaller id)
    r, c = knn._topk_rows(np.array([[1.0, 2.0, 1.0, 2.0, 1.0]]), np.ones((1, 5), bool), 3)
    assert sorted(c) == [0, 1, 3]
    # k >= n keeps all valid; fewer valid than k keeps only the valid ones
    r, c = knn._topk_rows(np.array([[1.0, 2.0, 2.0, 1.0]]), np.array([[True, True, True, False]]), 10)
    assert sorted(c) == [0, 1, 2]
    r, c = knn._topk_rows(np.array([[1.0, 2.0, 2.0, 1.0]]), np.array([[False, True, False, False]]), 3)
    assert list(c) == [1]


def _brute_jaccard(pairs, k, fill):
    sets = {}
    for u, a in pairs:
        sets.setdefault(u, set()).add(a)
    out = set()
    for u in sets:
        cands = []
        for v in sets:
            if v == u:
                continue
            o = len(sets[u] & sets[v])
            if o == 0 and not fill:
                continue
            cands.append((-(o / (len(sets[u]) + len(sets[v]) - o)), v))
        for rank, (s, v) in enumerate(sorted(cands)[:k], 1):
            out.add((u, v, rank))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 12)), min_size=2, max_size=120), st.integers(1, 6), st.booleans(), st.sampled_from([1, 4, 8, 99]))
def test_jaccard_matches_brute_force(spark, pairs, k, fill, hot):
    df = spark.createDataFrame([(f"u{u:02d}", f"a{a}") for u, a in pairs], "user string, app string")
    got = {(r.src, r.dst, r.rank) for r in knn.jaccard_topk(df, k, fill, block_size=4, hot_users=hot, group_overlaps=50).collect()}
    assert got == _brute_jaccard([(f"u{u:02d}", f"a{a}") for u, a in pairs], k, fill)


def test_jaccard_hot_app_and_zero_fill(spark):
    # one app used by every user plus a sparse tail; a user with no overlap at all
    rows = [(u, 0) for u in range(40)] + [(u, 1 + u % 7) for u in range(40)] + [(99, 500)]
    df = spark.createDataFrame(rows, "user bigint, app bigint")
    out = knn.jaccard_topk(df, 5, fill=True, block_size=8)
    per = {}
    for r in out.collect():
        per.setdefault(r.src, []).append((r.rank, r.dst, r.score))
    assert all(len(v) == 5 for v in per.values())            # exactly min(k, n-1)
    assert [d for _, d, _ in sorted(per[99])] == [0, 1, 2, 3, 4]  # zero-score fill in id order
    assert {(r.src, r.dst) for r in out.collect()} == {(u, v, ) for u, v, _ in _brute_jaccard(rows, 5, True)}
    none = knn.jaccard_topk(df, 5, fill=False, block_size=8)
    assert none.where("src = 99").count() == 0


def _hot_and_rare(n=120):
    """App 0 of all users, apps 1 and 2 of a third each; rare apps by which some users are close."""
    rng = random.Random(5)
    rows = [(u, 0) for u in range(n)] + [(u, 1 + u % 3) for u in range(n) if u % 3 < 2]
    rows += [(u, 100 + rng.randrange(30)) for u in range(0, n, 2) for _ in range(6)]
    return rows + [(u, 500 + u // 8) for u in range(n)] + [(u, 600 + u // 8) for u in range(0, n, 3)]


def test_jaccard_with_hot_apps(spark):
    rows = _hot_and_rare()
    df = spark.createDataFrame(rows, "user bigint, app bigint")
    for hot in (10, 50, 200):
        for k in (1, 5):
            got = {(r.src, r.dst, r.rank) for r in knn.jaccard_topk(df, k, block_size=16, hot_users=hot).collect()}
            assert got == _brute_jaccard(rows, k, True)


def test_hot_apps_are_not_listed(spark, monkeypatch):
    """Only users whose k-th score hot apps could reach meet all others; what is counted follows the rare overlaps."""
    rows = [(u, 0) for u in range(300)] + [(u, 1000 + u // 3 * 5 + a) for u in range(300) for a in range(5)]
    df = spark.createDataFrame(rows, "user bigint, app bigint")
    met = []
    cells = knn._jaccard_cells
    monkeypatch.setattr(knn, "_jaccard_cells", lambda rest, *a: met.append(rest.count()) or cells(rest, *a))
    got = {(r.src, r.dst, r.rank) for r in knn.jaccard_topk(df, 2, hot_users=100).collect()}
    assert got == _brute_jaccard(rows, 2, True)
    assert met == [0]  # each has two near users by five rare apps: 1 of 6 apps is below that
    knn.jaccard_topk(df, 3, hot_users=100).collect()
    assert met[-1] == 300  # the third one shares the hot app only


def test_lists_follow_overlaps(spark):
    """What blocks are sent is bounded by the overlaps, not by users x blocks."""
    packed = spark.range(4000).selectExpr("id AS user", "1L AS n", "0L AS h", "array(id DIV 2) AS cold")
    blocked, lists = knn._blocks_and_lists(packed, 160)
    assert blocked.select("_b").distinct().count() == 160
    assert lists.selectExpr("sum(size(users))").first()[0] <= 2000 * 2 * 2  # 2,000 apps of two users: at most 4 entries for each


def test_rows_without_user_or_app(spark):
    rows = [(1, 1), (2, 1), (None, 1), (3, None), (4, 2)]
    df = spark.createDataFrame(rows, "user bigint, app bigint")
    assert {(r.src, r.dst) for r in knn.jaccard_topk(df, 1).collect()} == {(1, 2), (2, 1), (4, 1)}
    assert knn.jaccard_topk(df.where("user IS NULL"), 3).collect() == []


def test_graph_symmetric_no_self(spark):
    rng = random.Random(3)
    rows = [(u, rng.randint(0, 15)) for u in range(30) for _ in range(4)]
    g = knn.direct_graph(spark.createDataFrame(rows, "user bigint, app bigint"), 3, block_size=8)
    e = {(r.src, r.dst) for r in g.collect()}
    assert all((b, a) in e for a, b in e) and all(a != b for a, b in e)


def test_cosine_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(37, 6))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(37)], "id bigint, vec array<double>")
    got = {(r.src, r.dst) for r in knn.cosine_topk(df, 4, block_size=5).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    want = set()
    for i in range(37):
        order = sorted((-s[i, j], j) for j in range(37) if j != i)[:4]
        want |= {(i, j) for _, j in order}
    assert got == want


def test_few_items_many_blocks(spark):
    # fewer items than blocks: some hash blocks are empty
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id bigint, vec array<double>")
    assert knn.cosine_topk(df, 2, block_size=1).count() == 6
    u = spark.createDataFrame([(i, i % 2) for i in range(3)], "user bigint, app bigint")
    assert knn.jaccard_topk(u, 2, block_size=1).count() == 6


def test_cosine_ties_do_not_follow_the_block_size(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16)).tolist() + [[0.0] * 16]
    rows = [(3 * i + c, v) for i, v in enumerate(base) for c in range(3)]  # every vector three times, a zero vector too
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    results = [{tuple(r) for r in knn.cosine_topk(vectors, 7, block_size=b).select("src", "rank", "dst").collect()} for b in (7, 20, 64, 4096)]
    assert len(results[0]) == 7 * len(rows) and all(r == results[0] for r in results)


def test_common_apps_are_not_listed(spark, monkeypatch):
    """Where lists would be sent hundreds of times per pair, users meet in cells; both kinds of cells count rightly."""
    monkeypatch.setattr(knn, "LISTED_PER_PAIR", 3)
    rng = random.Random(11)
    monkeypatch.setattr(knn, "_listed_scores", lambda *a: 1 / 0)
    for n_apps, used in ((12, 6), (400, 12)):  # a product; counted
        rows = [(u, rng.randrange(n_apps)) for u in range(150) for _ in range(used)]
        df = spark.createDataFrame(rows, "user bigint, app bigint")
        for fill in (True, False):
            got = {(r.src, r.dst, r.rank) for r in knn.jaccard_topk(df, 4, fill, block_size=40).collect()}
            assert got == _brute_jaccard(rows, 4, fill)


def test_a_cell_sends_few_rows_of_each_user():
    """A row block meets many column blocks' worth of users at once: it sends k rows per user, whatever the columns."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 5))
    cell = pd.DataFrame({"id": np.r_[:300, :20_000], "vec": [*x[:300], *x], "_row": np.r_[:300, :20_000], "_side": np.repeat([0, 1], (300, 20_000))})
    got = knn._cosine_cell(10, True)(cell)
    assert len(got) == 3000
    s = knn._cosines(x[:300], x)
    s[np.arange(300), np.arange(300)] = -np.inf
    r, c = knn._topk_rows(s, np.isfinite(s), 10)
    assert got["src"].tolist() == r.tolist() and got["dst"].tolist() == c.tolist() and got["score"].tolist() == s[r, c].tolist()


def test_bits_of_any_number_of_apps():
    """Counts beyond a byte, sets of all sizes, equal scores, users that are not among the columns: as counted overlaps."""
    rng = np.random.default_rng(7)
    for n_apps in (3, 64, 150, 700):
        there = rng.random((500, n_apps)) < rng.choice([0.02, 0.3, 0.9], 500)[:, None]
        there[np.arange(500), rng.integers(0, n_apps, 500)] = True  # every user has an app
        there[100:130] = there[0]  # many equal ones
        own = rng.permutation(500)[:90]
        (ia, ca), (ib, cb) = np.nonzero(there[own]), np.nonzero(there)
        sizes, itself = (there[own].sum(axis=1), there.sum(axis=1)), np.where(own % 3 == 0, -1, own)
        bits = knn._bit_words(ia, ca, 90, n_apps), knn._bit_words(ib, cb, 500, n_apps)
        got = knn._bits_best(*bits, sizes, n_apps, 7, itself)
        want = knn._counted_best(ca, np.concatenate([[0], np.cumsum(sizes[0])]), cb, ib, sizes, 7, itself)
        assert all(g.tolist() == w.tolist() for g, w in zip(got, want))


def test_near_cosines_in_single_precision_lose_no_neighbour():
    """Scores that single precision can't tell apart: the exact ones decide."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=8) + rng.normal(size=(3000, 8)) * 1e-5
    cell = pd.DataFrame({"id": np.r_[:40, :3000], "vec": [*x[:40], *x], "_row": np.r_[:40, :3000], "_side": np.repeat([0, 1], (40, 3000))})
    got = knn._cosine_cell(6, True)(cell)
    s = knn._cosines(x[:40], x)
    s[np.arange(40), np.arange(40)] = -np.inf
    r, c = knn._topk_rows(s, np.isfinite(s), 6)
    assert got["src"].tolist() == r.tolist() and got["dst"].tolist() == c.tolist()
