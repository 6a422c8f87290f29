"""Exact top-k inner products of a query set against all vectors, in order of length.

Components are quantised to integers, ``floor(scale * x)``, so scores are exact
and ties are real. Candidates are range-partitioned by descending length into
tiles; queries are packed into blocks. The right singular vectors of the whole
matrix (from its Gram matrix, summed over all rows) rotate both sides so that
few leading coordinates hold most of every product. In a tile, a query's
products over the leading coordinates plus the Cauchy-Schwarz bound of the
rest, |q_rest| |v_rest|, are compared with the query's k-th best score so far;
only what may reach it is multiplied out, in integers. A tile whose longest
vector cannot reach any of a block's k-th scores is never sent to that block.

Tiles are taken in rounds of doubling numbers, longest vectors first. After
each round the k best of every query are stored and give the next round its
bounds, so a round finds about k candidates per query, not k per tile, and the
rounds end when no tile can hold a better one. One task multiplies at most
``GROUP`` query blocks with one tile, whatever the sizes of the tables; the
driver sees the Gram matrix (dimension squared) and a count per round.

Defined cases: null vectors, vectors with a null, NaN or infinite component and
rows without an id take no part. Vectors of different lengths are compared as
if the shorter one went on with zeros; an empty vector is all zeros. Every row
is a candidate, so repeated rows take a rank each; a query never meets rows of
its own id. An id that queries twice does so once, with its least vector. Ties
go to the smaller id. Scores beyond a 64-bit integer become its largest or
least value. Only the named columns are read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitnet.llm.common import map_batches, stored, struct_of

SCALE = 256
#: Candidates of a tile, queries of a block, blocks that one task multiplies with one tile.
TILE, BLOCK, GROUP = 8192, 512, 32
#: Candidates multiplied at a time.
COLUMNS = 1024
#: The leading coordinates hold this share of the matrix's squared length.
LEADING_SHARE = 0.8
#: Above this share of survivors a whole product is cheaper than picked pairs.
DENSE_SHARE = 0.1
BLOCK_BITS = 24
LEAST, MOST = -(2**63), 2**63 - 1

VECTORS = "vec_id long, length double, vector binary"
TILES = "tile long, longest double, ids binary, widths binary, vectors binary"
FOUND = "block long, place int, score long, vec_id long"
BARS = "array<struct<place:int,score:bigint,vec_id:bigint>>"


def _quantised(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lists = batch.column("vector")
            flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))  # a null reads as NaN
            whole = np.clip(np.nan_to_num(flat), -(2.0**62), 2.0**62).astype("<i8")
            offsets, present = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            ids, lengths, vectors = [], [], []
            for i, valid, p, q in zip(batch.column("vec_id").to_pylist(), present, offsets[:-1], offsets[1:]):
                if i is not None and valid and np.isfinite(flat[p:q]).all():
                    ids.append(i)
                    lengths.append(math.sqrt(flat[p:q] @ flat[p:q]))
                    vectors.append(whole[p:q].tobytes())
            yield {"vec_id": ids, "length": lengths, "vector": vectors}

    return run


def quantise(df: DataFrame, scale: float = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, length, vector)``: integer vectors (little-endian 64-bit) of the rows that take part."""
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    return map_batches(own, _quantised(scale), VECTORS)


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width), np.int64)
    for row, x in zip(out, raw):
        row[: len(x) // 8] = np.frombuffer(x, "<i8")
    return out


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    total, rows = np.zeros((0, 0)), 0
    for batch in batches:
        raw = batch.column("vector").to_pylist()
        rows += len(raw)
        width = max([len(total), *(len(x) // 8 for x in raw)])
        x = _matrix(raw, width).astype(np.float64)
        total = np.pad(total, (0, width - len(total))) + x.T @ x
    i, j = np.triu_indices(len(total))
    yield {"i": [-1, *i.tolist()], "j": [-1, *j.tolist()], "value": [float(rows), *total[i, j].tolist()]}


def rotation(vectors: DataFrame, share: float = LEADING_SHARE) -> tuple[int, np.ndarray, int]:
    """Rows, the right singular vectors as columns (largest first), and how many of these hold ``share``."""
    found = map_batches(vectors.select("vector"), _gram, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    cells = found.collect()  # the upper half of a matrix of the vectors' dimension, and the count
    width = 1 + max([c["i"] for c in cells], default=-1)
    gram, rows = np.zeros((width, width)), 0
    for c in cells:
        if c["i"] < 0:
            rows = int(c["value"])
        else:
            gram[c["i"], c["j"]] = gram[c["j"], c["i"]] = c["value"]
    if not width:
        return rows, gram, 0
    energy, basis = np.linalg.eigh(gram / max(gram.max(), 1.0))
    energy, basis = np.maximum(energy[::-1], 0), basis[:, ::-1]
    leading = int(np.searchsorted(np.cumsum(energy), share * energy.sum())) + 1
    return rows, basis, min(leading, width)


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first = TaskContext.get().partitionId() << BLOCK_BITS
        ids, lengths, vectors = [], [], []

        def rows(n: int) -> dict:
            raw = lambda x: [np.array(x, "<i8").tobytes()]
            out = {
                "tile": [first], "longest": [max(lengths[:n])], "ids": raw(ids[:n]),
                "widths": raw([len(x) // 8 for x in vectors[:n]]), "vectors": [b"".join(vectors[:n])],
            }
            del ids[:n], lengths[:n], vectors[:n]
            return out

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            lengths += batch.column("length").to_pylist()
            vectors += batch.column("vector").to_pylist()
            while len(ids) >= size:
                yield rows(size)
                first += 1
        if ids:
            yield rows(len(ids))

    return run


def packed(vectors: DataFrame, rows: int, size: int) -> DataFrame:
    """Vectors in tiles of at most ``size``, by descending length (then ascending id), numbered in that order."""
    order = [F.col("length").desc(), F.col("vec_id")]
    placed = vectors.repartitionByRange(max(1, math.ceil(rows / size)), *order).sortWithinPartitions(*order)
    return stored(map_batches(placed, _packed(size), TILES), "product-tiles")


class _Side:
    """One packed tile or block: ids, integer rows, and their rotated halves."""

    def __init__(self, row: dict, basis: np.ndarray, leading: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        widths, flat = np.frombuffer(row["widths"], "<i8"), np.frombuffer(row["vectors"], "<i8")
        self.rows = np.zeros((len(self.ids), len(basis)), np.int64)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(widths) - widths, widths)
        self.rows[np.repeat(np.arange(len(widths)), widths), at] = flat
        self.floats = self.rows.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))
        turned = self.floats @ basis
        self.head = turned[:, :leading]
        self.rest = np.linalg.norm(turned[:, leading:], axis=1)
        self.length = np.linalg.norm(self.floats, axis=1)


def _exact(q: _Side, v: _Side, at: slice, row: np.ndarray | None = None, column: np.ndarray | None = None) -> np.ndarray:
    """Integer products of all rows, or of picked pairs. Doubles hold them exactly below 2^53."""
    small = q.largest * v.largest * max(q.rows.shape[1], 1) < 2.0**53
    if row is None:
        if small:
            return (q.floats @ v.floats[at].T).astype(np.int64)
        whole = q.rows.astype(object) @ v.rows[at].T.astype(object)
        return np.clip(whole, LEAST, MOST).astype(np.int64)
    if small:
        return np.einsum("ij,ij->i", q.floats[row], v.floats[at][column]).astype(np.int64)
    whole = (q.rows[row].astype(object) * v.rows[at][column].astype(object)).sum(axis=1)
    return np.clip(whole, LEAST, MOST).astype(np.int64)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then least id."""
    order = np.lexsort((ids, ~score, row))  # ~x falls as x rises, at every 64-bit integer
    row, score, ids = row[order], score[order], ids[order]
    first = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], ids[keep]


def better(q: _Side, v: _Side, bar: np.ndarray, bar_id: np.ndarray, full: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, score, id)`` of at most k vectors of the tile per query, all better than its bar.

    ``bar`` and ``bar_id`` are the score and id of each query's k-th best so far; queries that are not ``full`` have none.
    """
    bar, bar_id, full = bar.copy(), bar_id.copy(), full.copy()
    held = (np.empty(0, np.int64),) * 3
    for begin in range(0, len(v.ids), COLUMNS):
        at = slice(begin, begin + COLUMNS)
        floor = np.where(full, bar.astype(np.float64), -np.inf)
        # what rounding may take from a bound: of the rotation and of the sums, far below this share of the lengths' product
        reach = 1e-9 * q.length[:, None] * v.length[at][None, :] + 1e-6
        reach += q.head @ v.head[at].T
        reach += q.rest[:, None] * v.rest[at][None, :]
        alive = (reach >= floor[:, None]) & (q.ids[:, None] != v.ids[at][None, :])
        row, column = np.nonzero(alive)
        if len(row) > DENSE_SHARE * alive.size:
            score = _exact(q, v, at)[row, column]
        else:
            score = _exact(q, v, at, row, column)
        ids = v.ids[at][column]
        good = ~full[row] | (score > bar[row]) | ((score == bar[row]) & (ids < bar_id[row]))
        if not good.any():
            continue
        held = _best(*(np.concatenate(x) for x in zip(held, (row[good], score[good], ids[good]))), k)
        n = np.bincount(held[0], minlength=len(q.ids))
        last = np.cumsum(n) - 1
        done = np.flatnonzero(n == k)  # these have k better ones: the least of them is the new bar
        bar[done], bar_id[done], full[done] = held[1][last[done]], held[2][last[done]], True
    return held


def _products(basis: np.ndarray, leading: int, k: int):
    def run(tiles: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 4]
        for tile in tiles.to_pylist():  # one
            v = _Side(tile, basis, leading)
            for row in blocks.to_pylist():
                q = _Side(row, basis, leading)
                bar, bar_id, full = np.zeros(len(q.ids), np.int64), np.zeros(len(q.ids), np.int64), np.zeros(len(q.ids), bool)
                for x in row["bars"] or []:
                    bar[x["place"]], bar_id[x["place"]], full[x["place"]] = x["score"], x["vec_id"], True
                place, score, ids = better(q, v, bar, bar_id, full, k)
                out.append((np.full(len(place), row["block"]), place, score, ids))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])], ["block", "place", "score", "vec_id"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for block, ids, widths, vectors in zip(*(batch.column(n).to_pylist() for n in ("block", "ids", "widths", "vectors"))):
            widths, flat = np.frombuffer(widths, "<i8"), np.frombuffer(vectors, "<i8").astype(np.float64)
            upto = np.concatenate([[0], np.cumsum(flat * flat)])
            ends = np.cumsum(widths)
            yield {
                "block": np.full(len(widths), block),
                "place": np.arange(len(widths), dtype=np.int32),
                "query_id": np.frombuffer(ids, "<i8"),
                "query_length": np.sqrt(np.maximum(upto[ends] - upto[ends - widths], 0)),
            }


def _asking(blocks: DataFrame, members: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """Blocks with the bars of their queries, and the least length at which a vector may pass one of these."""
    none = F.lit(float("-inf"))
    if best is None:
        return blocks.withColumns({"needs": none, "bars": F.lit(None).cast(BARS)})
    bars = members.join(best.where(F.col("rank") == k), ["block", "place"], "left")
    full = F.col("score").isNotNull()
    needs = F.when(full & (F.col("query_length") > 0), F.col("score") / F.col("query_length")).otherwise(none)
    bar = F.when(full, F.struct("place", "score", "vec_id"))
    # a list of a block's queries at most
    bars = stored(bars.groupBy("block").agg(F.min(needs).alias("needs"), F.collect_list(bar).cast(BARS).alias("bars")), "product-bars")
    return blocks.join(bars, "block")


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 5, scale: float = SCALE, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector of ``queries`` its ``k`` highest integer products with ``df``.

    ``queries`` has the same two columns; rows of ``df`` with the query's own id are left out.
    """
    vectors = stored(quantise(df, scale, vec_id, embedding), "product-vectors")
    asked = quantise(queries, scale, vec_id, embedding).groupBy("vec_id").agg(F.min(F.struct("vector", "length")).alias("x"))
    asked = stored(asked.select("vec_id", "x.length", "x.vector"), "product-queries")
    rows, basis, leading = rotation(vectors.unionByName(asked))
    n_asked = asked.count()
    tiles = packed(vectors, rows, TILE)
    part = F.shiftright("tile", BLOCK_BITS)  # partitions count up from the longest vectors on
    heads = stored(tiles.select("tile", "longest", part.alias("part")), "product-heads")
    last = heads.agg(F.max("part")).first()[0]
    n_parts = 0 if last is None else last + 1
    blocks = packed(asked, n_asked, BLOCK).withColumnRenamed("tile", "block").drop("longest")
    members = stored(map_batches(blocks, _members, "block long, place int, query_id long, query_length double"), "product-members")
    by_query = Window.partitionBy("block", "place")
    ranked = F.row_number().over(by_query.orderBy(F.col("score").desc(), "vec_id"))
    best, begin, many = None, 0, 1
    while begin < n_parts:
        end = min(begin + many, n_parts)
        asking = _asking(blocks, members, best, k)
        wanted = asking.select("block", "needs", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))).alias("part"))
        # a length times a length reaches a product: with room for what rounding takes
        pairs = wanted.join(heads, "part").where(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("needs"))
        own = F.shiftright("block", BLOCK_BITS) + F.col("block").bitwiseAND((1 << BLOCK_BITS) - 1)
        pairs = stored(pairs.select("block", "tile", F.floor(own / GROUP).alias("group")), "product-pairs")
        begin, many = end, many * 2
        if pairs.isEmpty():
            break
        left = tiles.join(pairs.select("tile", "group").distinct(), "tile").toDF(*tiles.columns, "group")  # other columns than those of ``pairs``
        right = asking.join(pairs, "block")
        both = left.groupBy("tile", "group").cogroup(right.groupBy("tile", "group"))
        found = both.applyInArrow(_products(basis, leading, k), struct_of(FOUND))
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", ranked).where(F.col("rank") <= k), "product-best")
    if best is None:
        best = df.sparkSession.createDataFrame([], FOUND + ", rank int")
    return best.join(members, ["block", "place"]).select("query_id", "rank", "vec_id", "score")
