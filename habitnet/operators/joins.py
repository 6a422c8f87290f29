"""Join helpers shared by the operators.

No join here carries a broadcast hint: adaptive execution broadcasts a side once
its measured bytes are below the session's threshold, at any input size. Above
it, AQE splits a hot key's partition, but only where both sides of the join come
straight from an exchange. Distinct keys are an aggregate, whose partitioning a
join right above it would take over; so keys are checkpointed before they are
joined. They are never more than the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitnet.session import cut_lineage


def semi_join(df: DataFrame, keys: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """``df`` rows whose ``left_on`` appears in ``keys`` (left semi join)."""
    right_on = right_on or left_on
    k = cut_lineage(keys.select(F.col(right_on).alias("_k")).distinct())
    return df.join(k, df[left_on] == k["_k"], "left_semi")


def both_ends_in(edges: DataFrame, nodes: DataFrame, node_col: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose two endpoints both belong to ``nodes``."""
    k = cut_lineage(nodes.select(F.col(node_col).alias("_k")).distinct())
    out = edges.join(k, edges[src] == k["_k"], "left_semi")
    return out.join(k, out[dst] == k["_k"], "left_semi")


def mirror(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every edge in both directions (duplicates kept; callers dedupe)."""
    others = [c for c in edges.columns if c not in (src, dst)]
    ends = F.array(F.struct(F.col(src).alias(src), F.col(dst).alias(dst)), F.struct(F.col(dst).alias(src), F.col(src).alias(dst)))
    return edges.select(*others, F.inline(ends)).select(src, dst, *others)
