"""Rounds of messages between packed blocks, for models that move little data many times.

A *place* (a number) owns one packed piece of a model: a tile of samples or a
block of factor rows. Its fixed part is a row of a ``static`` frame, cached by
place; what changes travels as messages. In one round every place gets the
messages sent to it, beside its static row, and sends others: one shuffle of
blocks, whose size is the factors', never the samples'. A model's step is a few
rounds, and several steps are one Spark job: the plan is a chain, so it grows
with the rounds and is cut by a checkpoint after each window of steps.

Sizes are bounded by construction: ids are dealt to blocks of about
``IDS_PER_BLOCK`` (or as many as have ``BLOCK_NUMBERS`` numbers: every block goes
to a whole row or column of tiles, so few large ones move less), tiles hold at most about ``TILE_ROWS`` rows, and a pair of
blocks with more rows than that gets several tiles.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitnet.session import cut_compact, cut_lineage, cut_round, free_shuffles

# Functions of this module run in Python workers: shipped by value, as in ``knn``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDS_PER_BLOCK = 20_000
BLOCK_NUMBERS = 1 << 21
TILE_ROWS = 250_000
#: Tiles of one pair of blocks are numbered below 2 to this power.
CHUNK_BITS = 20

MESSAGE = "place long, role string, source long, numbers binary, more binary"
STATIC = "place long, kind string, near array<long>, a binary, b binary, c binary, d binary"

#: ``(place, static row or None, messages by role)`` -> messages ``(place, role, source, numbers, more)``.
Round = Callable[[int, dict | None, dict[str, list[dict]]], Iterable[tuple]]


def doubles(raw: bytes, width: int | None = None) -> np.ndarray:
    flat = np.frombuffer(raw, np.float64)
    return flat if width is None else flat.reshape(-1, width)


def integers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def raw(x: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def sum_rows(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` that share a key; ``key`` is sorted."""
    if not len(key):
        return key, values
    begin = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return key[begin], np.add.reduceat(values, begin, axis=0)


def added(messages: list[dict], shape: tuple[int, int]) -> np.ndarray:
    """The sum of partial rows sent as (row numbers in ``more``, rows in ``numbers``)."""
    total = np.zeros(shape)
    for m in messages:
        total[integers(m["more"])] += doubles(m["numbers"], shape[1])
    return total


def waiting(place: int, inbox: dict[str, list[dict]]) -> Iterable[tuple]:
    """A place that a round passes over keeps its messages."""
    for role, messages in inbox.items():
        for m in messages:
            yield place, role, m["source"], m["numbers"], m["more"]


def _group(step: Round):
    def run(key, inbox: pa.Table, static: pa.Table) -> pa.Table:
        by_role: dict[str, list[dict]] = {}
        # by source: sums then do not depend on the order of arrival
        for m in sorted(inbox.to_pylist(), key=lambda m: (m["role"], m["source"])):
            by_role.setdefault(m["role"], []).append(m)
        held = static.to_pylist()
        sent = list(step(key[0].as_py(), held[0] if held else None, by_role))
        columns = list(zip(*sent)) if sent else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["place", "role", "source", "numbers", "more"])

    return run


def rounds(messages: DataFrame, steps: Iterable[tuple[DataFrame, Round]], parts: int) -> DataFrame:
    """The messages after one round for each ``(static, step)``. ``static`` is dealt to ``parts`` by place."""
    for static, step in steps:
        dealt = messages.repartition(parts, "place")
        messages = dealt.groupBy("place").cogroup(static.groupBy("place")).applyInArrow(_group(step), MESSAGE)
    return messages


def advanced(messages: DataFrame, steps: Iterable[tuple[DataFrame, Round]], parts: int, roles: tuple[str, ...] | None = None) -> DataFrame:
    """``rounds``, run as one job and checkpointed; of ``roles`` only, if given.

    Adaptive execution is off while the job runs: every shuffle has a stated
    number of partitions, so there is nothing to adapt, and planning the rest of
    the chain anew after each of its stages takes longer than a round.
    """
    conf, key = messages.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        out = rounds(messages, steps, parts)
        return cut_round(out if roles is None else out.where(F.col("role").isin(*roles)))
    finally:
        conf.set(key, before)
        free_shuffles(messages.sparkSession)  # else the messages of all windows stay on disk


def dealt(static: DataFrame, parts: int) -> DataFrame:
    """``static`` checkpointed once and cached by place: rounds leave it where it is."""
    out = static.repartition(parts, "place").persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def indexed(ids: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(key, block, nth)``: distinct ids dealt to blocks by hash and counted in each (a block's ids are one window)."""
    own = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return cut_round(own.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1))


def grid(n_rows: int, n_left: int, n_right: int, tile_rows: int = TILE_ROWS, ids_per_block: int = IDS_PER_BLOCK) -> tuple[int, int]:
    """Blocks of the left and of the right ids, so that a tile has about ``tile_rows`` rows.

    Few large tiles: a round's fixed cost per task outweighs the work on small ones.
    """
    tiles = math.ceil(n_rows / tile_rows)
    left = max(1, math.ceil(n_left / ids_per_block), min(n_left, math.ceil(math.sqrt(tiles))))
    right = max(1, math.ceil(n_right / ids_per_block), min(n_right, math.ceil(tiles / left)))
    return left, right


def tile_places(rows: DataFrame, left: str, right: str, n_right: int, spread: list[Column], tile_rows: int) -> DataFrame:
    """``rows`` with the place of their tile: one per pair of blocks, or as many as its rows need.

    Counts per pair of blocks are joined back, not a window over a pair's rows.
    """
    rows = cut_compact(rows)
    sizes = rows.groupBy(left, right).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile_rows))).alias("_chunks"))
    chunk = F.pmod(F.xxhash64(*spread), F.col("_chunks"))
    pair = F.col(left).cast("long") * F.lit(n_right) + F.col(right)
    return rows.join(cut_lineage(sizes), [left, right]).withColumn("place", F.shiftleft(pair, CHUNK_BITS) + chunk).drop("_chunks")


def tiles_of_blocks(tiles: DataFrame, kinds: dict[int, str]) -> DataFrame:
    """Static rows of the blocks that tiles are near to: each lists its tiles. ``kinds``: by place in a tile's ``near``."""
    out = None
    for nth, kind in kinds.items():
        own = tiles.select(F.element_at("near", nth + 1).alias("block"), "place").groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("near"))
        none = [F.lit(None).cast("binary").alias(c) for c in "abcd"]
        own = own.select(F.col("block").alias("place"), F.lit(kind).alias("kind"), "near", *none)
        out = own if out is None else out.unionByName(own)
    return out


def left_place(block: Column) -> Column:
    """Tiles' places are 0 and above; what is not a tile has one of three series of negative numbers."""
    return -1 - 4 * block.cast("long")


def right_place(block: Column) -> Column:
    return -2 - 4 * block.cast("long")


def third_place(nth: Column) -> Column:
    return -3 - 4 * nth.cast("long")


def initial_state(factors: DataFrame, index: DataFrame, key: str, place: Column, names: list[str]) -> DataFrame:
    """Blocks' first messages to themselves: the columns ``names`` (repeated ones too) of their ids, in order of ``nth``."""
    columns = list(dict.fromkeys(names))
    own = factors.join(index.withColumnRenamed(key, "id"), "id").select(place.alias("place"), "nth", *columns)

    def pack(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("nth").to_numpy())
        x = {n: rows.column(n).to_numpy()[order] for n in columns}
        at = rows.column("place")[0].as_py()
        whole = [[at], ["S"], [at], [raw(np.stack([x[n] for n in names], axis=1), np.float64)], [b""]]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(whole, kinds)], ["place", "role", "source", "numbers", "more"])

    return own.groupBy("place").applyInArrow(pack, MESSAGE)


def unpacked(state: DataFrame, index: DataFrame, key: str, place: Column, names: list[str], copies: int = 1, copy: int = 0) -> DataFrame:
    """``(id, names...)`` from blocks' messages to themselves; of several copies the one named."""
    width = len(names)

    def rows(batches):
        for batch in batches:
            for at, numbers in zip(batch.column("place").to_pylist(), batch.column("numbers").to_pylist()):
                x = doubles(numbers, width)[copy::copies]
                columns = [np.full(len(x), at), np.arange(len(x), dtype=np.int32), *(x[:, c] for c in range(width))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "nth", *names])

    schema = "place long, nth int, " + ", ".join(f"{n} double" for n in names)
    found = state.where(F.col("role") == "S").select("place", "numbers").mapInArrow(rows, schema)
    ids = index.select(F.col(key).alias("id"), place.alias("place"), "nth")
    return ids.join(found, ["place", "nth"]).select("id", *names)


def summed_logs(state: DataFrame) -> np.ndarray:
    """Element by element, the sum of the logs (``more``) that places keep in their messages to themselves."""

    def parts(batches):
        total = np.zeros(0)
        for batch in batches:
            for log in batch.column("more").to_pylist():
                x = doubles(log)
                total = np.pad(total, (0, max(0, len(x) - len(total))))
                total[: len(x)] += x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["nth", "value"])

    found = state.where((F.col("role") == "S") & (F.octet_length("more") > 0)).select("more").mapInArrow(parts, "nth int, value double")
    rows = found.groupBy("nth").agg(F.sum("value").alias("value")).collect()  # a few numbers per step
    out = np.zeros(1 + max([r["nth"] for r in rows], default=-1))
    for r in rows:
        out[r["nth"]] = r["value"]
    return out
