import math
import random

import pytest
from habitnet.llm import inner_products

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, asked, k, scale):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(scale * single(x)) for x in v]
    kept = [(i, whole(v)) for i, v in rows if i is not None and good(v)]
    out = []
    for q, x in [(i, whole(v)) for i, v in asked if i is not None and good(v)]:
        scores = [(-max(min(sum(a * b for a, b in zip(x, v)), 2**63 - 1), -(2**63)), i) for i, v in kept if i != q]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(spark, rows, asked, k=5, scale=256):
    found = inner_products.top_k(frame(spark, rows), frame(spark, asked), k, scale)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture
def small(monkeypatch):
    for name, n in (("TILE", 40), ("BLOCK", 3), ("GROUP", 2), ("COLUMNS", 7)):
        monkeypatch.setattr(inner_products, name, n)


def vectors(n, width, seed=3):
    r = random.Random(seed)
    mixed = [[r.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    return [(i, [sum(r.gauss(0, 1) * m[j] for m in mixed) * r.choice([0.1, 1, 3]) + r.gauss(0, 0.05) for j in range(width)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_brute_force(spark, small, k):
    rows = vectors(300, 12)
    asked = rows[::50]
    assert got(spark, rows, asked, k) == brute(rows, asked, k, 256)


def test_hot_vector_and_ties(spark, small):
    """A third of the rows are one vector, others tie with it at other lengths; repeated rows take a rank each."""
    rows = [(i, [0.5, 0.25, 0.0]) for i in range(100, 200)]
    rows += [(i, [0.5, 0.25, float(i % 9)]) for i in range(60)] + [(250, [0.5, 0.25, 9.0])] * 3 + vectors(100, 3, 5)[60:]
    asked = [(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, -1.0, 0.5]), (150, [0.5, 0.25, 0.0]), (9_999, [0.0, 0.0, 1.0])]
    assert got(spark, rows, asked) == brute(rows, asked, 5, 256)


def test_odd_rows(spark, small):
    inf, nan = float("inf"), float("nan")
    rows = [(None, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.5])]
    asked = [*rows, (40, [2.0, 1.0, -1.0, 7.0])]
    assert got(spark, rows, asked) == brute(rows, asked, 5, 256)
    assert got(spark, [], asked) == [] and got(spark, rows, []) == [] and got(spark, [], []) == []


def test_large_components(spark, small):
    """Products beyond 2^53 are exact, those beyond 64 bits stop at its ends."""
    rows = [(i, [2.0**20 + i, float(i), 2.0**18]) for i in range(30)] + [(50, [2.0**30, 0.0, 0.0]), (51, [-(2.0**30), 1.0, 0.0])]
    asked = [rows[3], rows[-2], (60, [2.0**17, -3.0, 5.0])]
    assert got(spark, rows, asked) == brute(rows, asked, 5, 256)


def test_pruned_tiles_are_not_sent(spark, small):
    """Long vectors first: once these fill the answers, short ones are out of reach and their tiles stay away."""
    long = [(i, [10.0, float(i % 5)]) for i in range(40)]
    short = [(1000 + i, [0.01 * (i % 7), 0.02]) for i in range(400)]
    seen = []
    own = inner_products._asking
    inner_products._asking = lambda *a: seen.append(1) or own(*a)
    try:
        assert got(spark, long + short, [(5000, [1.0, 0.5])]) == brute(long + short, [(5000, [1.0, 0.5])], 5, 256)
    finally:
        inner_products._asking = own
    assert len(seen) <= 3  # of eleven tiles; rounds of 1, 2, 4 and 8 would see them all


def test_rotation_keeps_products(spark):
    rows = vectors(200, 6)
    held = inner_products.quantise(frame(spark, rows))
    n, basis, leading = inner_products.rotation(held)
    assert n == 200 and 1 <= leading <= 4  # three directions hold nearly all
    assert abs(basis.T @ basis - __import__("numpy").eye(6)).max() < 1e-12
