"""Contact graphs from call and message logs (M1..M3).

Graphs are edge frames ``(src, dst)`` holding both directions of every
contact, without duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitnet.operators.joins import both_ends_in, mirror


def voice_graph(voice: DataFrame, valid: DataFrame | None, min_sec: int, user_col: str = "user") -> DataFrame:
    """M1: calls of at least ``min_sec`` seconds (``dur`` is in ms) between two
    valid users, in both directions, distinct. Self-calls are kept."""
    v = voice.where(F.col("dur") >= F.lit(int(min_sec) * 1000)).select("src", "dst")
    if valid is not None:
        v = both_ends_in(v, valid, user_col)
    return mirror(v).distinct()


def mutual_sms_graph(sms: DataFrame, valid: DataFrame | None, user_col: str = "user") -> DataFrame:
    """Pairs whose messages, taken in both directions, carry both flag
    values (sent and received). Every record counts for (src, dst) and
    (dst, src), then a pair is kept when it has two distinct flags."""
    s = sms.select("src", "dst", "flag")
    if valid is not None:
        s = both_ends_in(s, valid, user_col)
    # both directions of a pair hold the same flags: counted once, mirrored after (structs compare nulls too)
    there, back = (F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src")))
    own = s.select(F.least(there, back).alias("_p"), "flag").select("_p.*", "flag")
    mutual = own.groupBy("src", "dst").agg(F.count_distinct("flag").alias("_n")).where(F.col("_n") == 2)
    ways = F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(there)).otherwise(F.array(there, back))
    return mutual.select(F.inline(ways))


def contact_graph(voice_edges: DataFrame, sms_edges: DataFrame) -> DataFrame:
    """Union of the two graphs, distinct."""
    return voice_edges.select("src", "dst").unionByName(sms_edges.select("src", "dst")).distinct()


def union_graphs(*graphs: DataFrame) -> DataFrame:
    """Union of any number of edge frames, distinct."""
    out = graphs[0].select("src", "dst")
    for g in graphs[1:]:
        out = out.unionByName(g.select("src", "dst"))
    return out.distinct()
