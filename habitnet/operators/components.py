"""Connected components and what is read off them (M4..M6, M28, T2..T5).

Components use the alternating large-star / small-star rounds of Kiveris et
al. (SoCC 2014) on an edge frame ``(hi, lo)`` with ``hi > lo``. It needs
O(log n) rounds instead of the O(diameter) rounds of min-label propagation,
and every round is two ``groupBy(min)`` + join pairs. Of a dense graph the rounds
first see two edges of each node (Afforest, Sutton et al., IPDPS 2018); then all
edges become edges between the components found so far, of which hardly any are
left, and the rounds go over those: so they move nodes, not edges. A hub node (one node
holding a third of all edges) only feeds a partial aggregate; the minima are
checkpointed before they are joined back, as AQE splits a hub's partition only
where both sides of a join come straight from an exchange. Each half round's
edges go to the reliable checkpoint folder too, so lineage stays short and a
lost executor costs at most half a round.

The component id is the least node id of the component (ties between equal
sizes then go to the least id, deterministically).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitnet.operators.joins import both_ends_in, mirror
from habitnet.session import cut_lineage, partition_count


DENSE = 2  # a graph of so many edges for each of the two that its nodes have at most is dense


def _canonical(edges: DataFrame, src: str, dst: str) -> DataFrame:
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    )
    return e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    # m(u) = min of u and all its neighbours; every larger neighbour v of u gets edge (v, m(u)).
    both = mirror(e, "hi", "lo").select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    mins = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.where(F.col("v") > F.col("u")).join(mins, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # For node u (as hi) with smaller neighbours L: m = min(L); connect u and L \ {m} to m.
    mins = cut_lineage(e.groupBy("hi").agg(F.min("lo").alias("m")))
    return (
        e.join(mins, "hi")
        .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _is_star_forest(e: DataFrame) -> bool:
    # Converged when every hi has exactly one edge and no lo is also a hi:
    # then each component is a star around its least node.
    roles = e.select(F.col("hi").alias("n"), F.lit(1).alias("h")).unionByName(e.select(F.col("lo").alias("n"), F.lit(0).alias("h")))
    bad = (
        roles.groupBy("n")
        .agg(F.sum("h").alias("nh"), F.count(F.lit(1)).alias("nt"))
        .where((F.col("nh") > 1) | ((F.col("nh") >= 1) & (F.col("nt") > F.col("nh"))))
    )
    return bad.limit(1).count() == 0


def _star_forest(e: DataFrame, max_rounds: int) -> DataFrame:
    """The edges ``(hi, lo)`` of a star around the least node of each component."""
    for _ in range(max_rounds):
        e = cut_lineage(_small_star(cut_lineage(_large_star(e))))
        if _is_star_forest(e):
            return e
    raise RuntimeError("connected_components did not converge")


def _two_each(e: DataFrame) -> DataFrame:
    """Of every node the edges to its least and greatest neighbour."""
    ends = mirror(e, "hi", "lo").groupBy("hi").agg(F.min("lo").alias("least"), F.max("lo").alias("most"))
    return _canonical(ends.select("hi", F.explode(F.array("least", "most")).alias("lo")), "hi", "lo")


def _contracted(e: DataFrame, forest: DataFrame) -> DataFrame:
    """The edges between the components of ``forest``, whose least nodes stand for them."""
    for end in ("hi", "lo"):
        of = forest.select(F.col("hi").alias("_n"), F.col("lo").alias("_c"))
        e = e.join(of, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    return _canonical(e, "hi", "lo")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """M4: ``(node, component)`` for every node that appears in ``edges``.

    Self edges only add their node. One scalar (the convergence test) comes
    back to the driver per round.
    """
    edges = cut_lineage(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")))  # input plan runs once
    src, dst = "src", "dst"
    nodes = edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node"))).where(F.col("node").isNotNull()).distinct()
    e = cut_lineage(_canonical(edges, src, dst))
    few = cut_lineage(_two_each(e))
    if DENSE * few.count() > e.count():
        e = _star_forest(e, max_rounds)
        return nodes.join(e, nodes.node == e.hi, "left").select("node", F.coalesce("lo", "node").alias("component"))
    first = _star_forest(few, max_rounds)
    rest = cut_lineage(_contracted(e, first))
    found = nodes.join(first, nodes.node == first.hi, "left").select("node", F.coalesce("lo", "node").alias("component"))
    if rest.isEmpty():
        return found
    then = _star_forest(rest, max_rounds)
    return found.join(then, found.component == then.hi, "left").select("node", F.coalesce("lo", "component").alias("component"))


def nested_components(edges: DataFrame, weight: str, bounds: Iterable[int], src: str = "src", dst: str = "dst") -> DataFrame:
    """M4 for several bounds on the edges' weight at once: (bound, node, component) of the edges of at least ``bound``.

    The graphs are nested, so the strictest comes first and every next one only
    joins its components: of the edges that the lower bound adds, both ends
    become components, and rounds run on what is left of these. Each edge is
    worked on once, not once per bound. Component ids are least node ids, as
    those of ``connected_components``.
    """
    e = cut_lineage(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(weight).alias("_w")).dropna(subset=["src", "dst", "_w"]))
    out, held, above = None, None, None
    for bound in sorted(set(bounds), reverse=True):
        own = e.where(F.col("_w") >= bound) if above is None else e.where((F.col("_w") >= bound) & (F.col("_w") < above))
        own, above = own.select("src", "dst"), bound
        if held is None:
            held = cut_lineage(connected_components(own))
        else:
            ends = own.select(F.col("src").alias("node")).unionByName(own.select(F.col("dst").alias("node"))).distinct()
            known = cut_lineage(held.unionByName(ends.join(held, "node", "left_anti").withColumn("component", F.col("node"))))
            a = known.select(F.col("node").alias("src"), F.col("component").alias("_a"))
            b = known.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
            between = own.join(a, "src").join(b, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).where("src <> dst").distinct()
            joined = cut_lineage(connected_components(between)).select(F.col("node").alias("component"), F.col("component").alias("_least"))
            held = cut_lineage(known.join(joined, "component", "left").select("node", F.coalesce("_least", "component").alias("component")))
        found = held.select(F.lit(bound).alias("bound"), "node", "component")
        out = found if out is None else out.unionByName(found)
    return out


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, size)."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def top_components(components: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest components, size descending then id ascending,
    with their 1-based rank. A global top-n: partial top-n per partition, then one merge."""
    sizes = component_sizes(components)
    top = sizes.orderBy(F.col("size").desc(), F.col("component").asc()).limit(n)
    w = Window.orderBy(F.col("size").desc(), F.col("component").asc())
    return top.withColumn("rank", F.row_number().over(w))  # n rows only


def largest_component(components: DataFrame) -> DataFrame:
    """T4: nodes of the largest component (ties to the least component id)."""
    top = top_components(components, 1).select(F.col("component").alias("_c"))
    return components.join(F.broadcast(top), components.component == top["_c"], "left_semi").select("node", "component")


def induced_subgraph(edges: DataFrame, nodes: DataFrame, node_col: str = "node") -> DataFrame:
    """The edges with both endpoints in ``nodes``."""
    return both_ends_in(edges.select("src", "dst"), nodes, node_col)


def consecutive_index(df: DataFrame, col: str, idx: str = "idx", order=None, num_partitions: int | None = None) -> DataFrame:
    """Distinct values of ``col`` numbered 0..n-1 in ascending order of
    ``order`` (a column expression, unique per value; default ``col`` itself).

    No single-task window: the values are range-partitioned and sorted, each
    row takes its position inside its partition from
    ``monotonically_increasing_id``, and a per-partition count (one row per
    partition, so its size is bounded by the partition count) gives the offsets.
    """
    spark = df.sparkSession
    base = cut_lineage(df.select(F.col(col).alias(col)).where(F.col(col).isNotNull()).distinct())
    n = num_partitions or partition_count(spark, base.count())
    base = base.withColumn("_ord", F.col(col) if order is None else order)
    s = (
        base.repartitionByRange(n, "_ord")
        .sortWithinPartitions("_ord")
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return s.join(F.broadcast(offsets), "_pid").select(
        col, (F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)).alias(idx)
    )


def recode_edges(edges: DataFrame, index: DataFrame, key: str = "node", idx: str = "idx") -> DataFrame:
    """Replace both endpoint ids by their integer index; edges with an
    endpoint missing from the index are dropped (inner joins)."""
    i = index.select(F.col(key).alias("_k"), F.col(idx).alias("_i"))
    s = edges.join(i, edges.src == i["_k"]).select(F.col("_i").alias("src"), "dst")
    return s.join(i, s.dst == i["_k"]).select("src", F.col("_i").alias("dst"))
