import random

from hypothesis import given, settings
from hypothesis import strategies as st

from habitnet.operators import components as cc


def _components(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    return {r.node: r.component for r in cc.connected_components(df).collect()}


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = {x for e in edges for x in e}
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_literal_shapes(spark):
    edges = [("a1", "a2"), ("a2", "a3"), ("a3", "a4"), ("a4", "a5"),   # path of 5
             ("t1", "t2"), ("t2", "t3"), ("t3", "t1"),                # triangle
             ("l1", "l2"),                                            # lone edge
             ("m2", "m3"), ("m1", "m2"),                              # tie of size 3 with the triangle
             ("s1", "s1")]                                            # self edge
    got = _components(spark, edges)
    assert got == _brute(edges)
    assert got["s1"] == "s1" and got["a5"] == "a1"
    comps = cc.connected_components(spark.createDataFrame(edges, "src string, dst string"))
    top = [(r.component, r.size, r.rank) for r in cc.top_components(comps, 3).collect()]
    assert top == [("a1", 5, 1), ("m1", 3, 2), ("t1", 3, 3)]   # tie to the least id
    assert {r.node for r in cc.largest_component(comps).collect()} == {"a1", "a2", "a3", "a4", "a5"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_random_graphs_match_union_find(spark, pairs):
    edges = [(f"n{a:02d}", f"n{b:02d}") for a, b in pairs]
    assert _components(spark, edges) == _brute(edges)


def test_induced_subgraph_and_index(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "x")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {(r.src, r.dst) for r in cc.induced_subgraph(edges, nodes).collect()} == {("a", "b"), ("b", "c")}
    vals = [f"v{random.Random(1).randint(0, 10**6) + i}" for i in range(200)]
    idx = cc.consecutive_index(spark.createDataFrame([(v,) for v in vals], "node string"), "node", num_partitions=7)
    got = sorted((r.idx, r.node) for r in idx.collect())
    assert [i for i, _ in got] == list(range(200))
    assert [n for _, n in got] == sorted(set(vals))


def test_recode_edges_drops_unknown(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "z")], "src string, dst string")
    idx = spark.createDataFrame([("a", 0), ("b", 1)], "node string, idx bigint")
    assert [(r.src, r.dst) for r in cc.recode_edges(edges, idx).collect()] == [(0, 1)]


def test_a_hub_with_a_third_of_all_edges(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(0, 800, 2)] + [(399, 5000), (5000, 5001)]
    got = {r["node"]: r["component"] for r in cc.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in [*range(400), 5000, 5001]) and all(got[1001 + i] == 1000 + i for i in range(0, 800, 2))


def test_nested_components_equal_those_of_each_bound(spark):
    rng = random.Random(9)
    rows = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}", rng.choice([5, 10, 15, 20, 25, 30, 40])) for _ in range(70)]
    rows += [("lone", "lone", 20), ("x1", "x2", 30), ("x2", "x3", 15), (None, "n01", 30), ("n01", "n02", None)]
    edges = spark.createDataFrame(rows, "src string, dst string, w int")
    got = {}
    for r in cc.nested_components(edges, "w", [15, 30, 20, 25, 99]).collect():
        got.setdefault(r.bound, {})[r.node] = r.component
    for bound in (15, 20, 25, 30):
        own = edges.where(f"w >= {bound}").dropna()
        assert got[bound] == {r.node: r.component for r in cc.connected_components(own).collect()}
    assert 99 not in got


def test_rounds_of_a_dense_graph_see_two_edges_a_node(spark, monkeypatch):
    rng, seen, round_of = random.Random(5), [], cc._large_star
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(a, b) for part in (nodes[:30], nodes[30:]) for a in part for b in part if a < b and rng.random() < 0.8]
    monkeypatch.setattr(cc, "_large_star", lambda e: (seen.append(e.count()), round_of(e))[1])
    assert _components(spark, edges) == _brute(edges)
    assert len(edges) > 300 and max(seen) <= 80


def test_components_that_two_edges_a_node_leave_apart(spark):
    """Each node's least and greatest neighbours are in its own half; the halves meet in between."""
    low, high = [f"a{i}" for i in range(10)], [f"z{i}" for i in range(10)]
    mid = [f"m{i}{side}" for i in range(6) for side in "xy"]
    edges = [(a, b) for side, ends in (("x", 0), ("y", 5)) for m in mid if m.endswith(side) for a, b in [(m, o) for o in low[ends : ends + 5] + high[ends : ends + 5]]]
    edges += [("m0x", "m0y"), ("m3x", "m4y")]
    assert _components(spark, edges) == _brute(edges)
    assert cc.connected_components(spark.createDataFrame(edges, "src string, dst string")).select("component").distinct().count() == 1
