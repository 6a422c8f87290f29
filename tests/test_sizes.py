"""Sizes of what is sent or held at once, from numbers of rows."""

import math

from habitnet.operators import blocks as bl
from habitnet.operators import exposure_blocks as eb
from habitnet.session import cut_compact
from habitnet.sources import tables as tb


def test_order_lines_partitions_follow_the_lines(spark, tmp_path, monkeypatch):
    lines = spark.range(60).selectExpr("id DIV 3 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1D AS l_quantity", "'O' AS l_linestatus",
                                       "'N' AS l_returnflag", "1 AS l_linenumber")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).selectExpr("id AS o_orderkey", "id % 4 AS o_custkey", "DATE'1997-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(tb, "partition_count", lambda spark, rows: math.ceil(rows / 5))
    found = tb.order_lines(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 12
    assert found.count() == 60


def test_blocks_of_a_large_model_are_few():
    """A round sends every block to its whole row or column of tiles."""
    users, apps, samples, width = 900_000, 1_200_000, 144_000_000, 10
    left, right = bl.grid(samples, users, apps, 2_000_000, bl.BLOCK_NUMBERS // width)
    sent = (right * users + left * apps) * width
    assert sent < samples * 2 and max(users / left, apps / right) * width <= bl.BLOCK_NUMBERS


def test_messages_of_places_and_user_blocks_are_alike():
    """Neither a row place nor a user block meets all tiles: what one of them sends grows with sqrt(rows x users) only."""
    for rows, users in ((100_000, 1500), (6_000_000, 90_000), (36_000_000, 540_000)):
        places, blocks = eb.row_and_user_blocks(rows, users, 3 * rows, 3, bl.TILE_ROWS)
        assert places * blocks >= 3 * rows / bl.TILE_ROWS
        assert max(rows / places * blocks, users / blocks * places) <= 2 * math.sqrt(rows * users)


def test_compact_copy_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (None, None, None)], "user long, app string, r double")
    copy = cut_compact(df)
    assert copy.schema == df.schema and sorted(copy.collect(), key=str) == sorted(df.collect(), key=str)
