"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (A-Z in lower case; runs of other ASCII characters than
letters and digits become one blank) and read as bytes. Benchmark items are cut
into overlapping segments of ``SEGMENT`` bytes; a document is contaminated by an item if a
stretch of it is within ``EDIT_PERCENT`` edits of one of the item's segments.

A stretch within k edits of a segment of w bytes shares at least
w - q + 1 - k q of its q-grams with it, and they lie on diagonals (place in the
document minus place in the segment) at most k apart. So q-grams that a
document shares with a segment are counted per band of diagonals; bands overlap
by k, so that some band holds all of them. Bands with enough are candidates,
and a banded alignment against the segment decides.

The benchmark is the query set: it is taken in blocks of about ``BLOCK_BYTES``,
each of which is sent to the workers and run against all documents, however
large the benchmark is.

Defined cases: null and empty texts and items match nothing; items shorter than
``SHORTEST`` normalised bytes have no segments and are found as whole words, without edits; a null doc_id or item_id is an
id like any other; rows that share a doc_id (or an item_id) are judged
together; empty tables give no rows. Texts are read whole, in
pieces that overlap; equal hits need no order, as any one flags the document. Other columns keep their
values whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitnet.llm.common import fresh_name, map_batches, stored, texts_of

Q = 8
SEGMENT = 64
#: Segments begin this far apart. A verbatim excerpt of SEGMENT bytes lacks at most half of it at one
#: end of some segment, which is within the edits allowed, so it is found wherever it begins.
STRIDE = 8
SHORTEST = 32
EDIT_PERCENT = 8
#: Diagonals of a band, beside those that it shares with the next.
BAND = 16
BLOCK_BYTES = 2 << 20
#: Normalised bytes of documents that are searched at a time.
BYTES_AT_ONCE = 1 << 21
FILTER_BITS = 22
#: Candidates aligned at a time.
ALIGNED_AT_ONCE = 4096

_KEPT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
CANDIDATE_SCHEMA = "doc_id long, item_id long, segment int, n_segments int, pattern binary, region binary"


def normalised(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_KEPT).split())


def edit_budget(length: int) -> int:
    return length * EDIT_PERCENT // 100


def segments(item: bytes) -> list[tuple[int, bytes]]:
    """``(begin, segment)``: every ``STRIDE`` bytes, the last one moved back to end where the item does."""
    if len(item) < SHORTEST:
        return []
    size = min(SEGMENT, len(item))
    begins = sorted({*range(0, len(item) - size + 1, STRIDE), len(item) - size})
    return [(b, item[b : b + size]) for b in begins]


def _grams(raw: bytes) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    return np.ndarray((max(len(raw) - Q + 1, 0),), "<u8", raw, strides=(1,)).copy()


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def index(items: pd.DataFrame) -> dict:
    """The q-grams of a block's segments: sorted, with the segments and places where they occur."""
    rows = [(i, n, s, len(parts)) for i, t in zip(items["item_id"], items["text"]) for parts in [segments(normalised(t or ""))] for n, (_, s) in enumerate(parts)]
    grams = [_grams(s) for _, _, s, _ in rows]
    lengths = np.array([len(s) for _, _, s, _ in rows], np.int64)
    budget = lengths * EDIT_PERCENT // 100
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    keys, first, count = np.unique(flat[order], return_index=True, return_counts=True)
    wanted = np.zeros(1 << FILTER_BITS, bool)
    wanted[_slot(keys)] = True
    return {
        "rows": [(None if pd.isna(i) else int(i), n, s, total) for i, n, s, total in rows],
        "budget": budget,
        "needed": lengths - Q + 1 - budget * Q,
        "keys": keys,
        "first": first,
        "count": count,
        "owner": owner[order],
        "place": place[order],
        "filter": wanted,
    }


def short_index(items: pd.DataFrame) -> dict[int, tuple[np.ndarray, dict]]:
    """The items without segments, each between blanks, by how many of its first bytes are looked up (8 at most)."""
    found: dict[int, dict] = {}
    for i, t in zip(items["item_id"], items["text"]):
        item = normalised(t or "")
        if 0 < len(item) < SHORTEST:
            whole = b" " + item + b" "
            size = min(len(whole), Q)
            found.setdefault(size, {}).setdefault(int.from_bytes(whole[:size], "little"), []).append((None if pd.isna(i) else int(i), whole))
    return {size: (np.array(sorted(own), np.uint64), own) for size, own in found.items()}


def short_items(raw: bytes, short: dict) -> set[tuple]:
    """``(item_id, item)`` of every item of ``short`` that stands in ``raw`` between blanks."""
    out = set()
    grams = _grams(raw + b"\0" * Q)
    for size, (keys, own) in short.items():
        first = grams & np.uint64((1 << 8 * size) - 1)
        key = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
        for at in np.flatnonzero(keys[key] == first).tolist():
            out.update((i, whole[1:-1]) for i, whole in own[int(first[at])] if raw.startswith(whole, at))
    return out


def _crowded(at: np.ndarray, many: int, width: int) -> np.ndarray:
    """Which of the ascending places lie with ``many`` in a stretch of ``width``.

    What keeps enough q-grams of a segment keeps them at so many places of a band. Others can't be part of a match.
    """
    if many <= 1:
        return np.ones(len(at), bool)
    starts = np.flatnonzero(at[many - 1 :] - at[: max(len(at) - many + 1, 0)] < width)
    edge = np.zeros(len(at) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + many, -1)
    return np.cumsum(edge[:-1]) > 0


def candidates(raw: bytes, block: dict) -> Iterator[tuple[int, int]]:
    """``(segment row, first diagonal of a band)`` of every band of ``raw`` with enough shared q-grams."""
    grams = _grams(raw)
    at = np.flatnonzero(block["filter"][_slot(grams)])
    if not len(at) or not len(block["keys"]):
        return
    key = np.minimum(np.searchsorted(block["keys"], grams[at]), len(block["keys"]) - 1)
    exact = block["keys"][key] == grams[at]
    at, key = at[exact], key[exact]
    close = _crowded(at, int(block["needed"].min()), SEGMENT + BAND + edit_budget(SEGMENT))
    at, key = at[close], key[close]
    times = block["count"][key]
    hit = np.repeat(block["first"][key], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    owner = block["owner"][hit]
    diagonal = np.repeat(at, times) - block["place"][hit] + SEGMENT  # never below zero
    band = diagonal // BAND
    again = (diagonal % BAND < block["budget"][owner]) & (band > 0)  # also on the rim of the band before
    stride = (len(raw) + SEGMENT) // BAND + 2
    keys, n = np.unique(np.concatenate([owner * stride + band, owner[again] * stride + band[again] - 1]), return_counts=True)
    owner, band = np.divmod(keys, stride)
    for o, b in zip(owner[enough := n >= block["needed"][owner]].tolist(), band[enough].tolist()):
        yield o, b * BAND - SEGMENT


def region(raw: bytes, begin: int, end: int, diagonal: int, length: int) -> bytes:
    """What of ``raw[begin:end]`` a segment of ``length`` can meet in the band from ``diagonal`` on.

    Zeros stand for what lies before ``begin``, so that it always begins where the band does.
    """
    budget = edit_budget(length)
    start, stop = diagonal - budget, diagonal + length + BAND + 2 * budget
    own = raw[max(begin, start) : max(min(end, stop), 0)]
    return b"\0" * (max(begin, start) - start) + own if own else b""


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block, short = shared.value
        names = ("doc_id", "item_id", "segment", "n_segments", "pattern", "region")
        reach = SEGMENT + BAND + 2 * edit_budget(SEGMENT)
        for batch in batches:
            rows: list[tuple] = []
            pieces, ids, size = [], [], 0

            def search() -> None:
                ends = np.cumsum([len(p) + Q for p in pieces]) - Q
                raw = (b"\0" * Q).join(pieces)  # no shared q-gram reaches over the gap
                for o, diagonal in candidates(raw, block):
                    item, n, segment, total = block["rows"][o]
                    for d in range(int(np.searchsorted(ends, diagonal)), len(pieces)):  # every document that the band touches
                        begin = int(ends[d]) - len(pieces[d])
                        if begin > diagonal + reach:
                            break
                        own = region(raw, begin, int(ends[d]), diagonal, len(segment))
                        if own:
                            rows.append((ids[d], item, n, total, segment, own))

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                whole = normalised(text)
                if short:
                    padded = b" " + whole + b" "
                    here = set().union(*(short_items(padded[at : at + BYTES_AT_ONCE + SHORTEST + 2], short) for at in range(0, len(padded), BYTES_AT_ONCE)))
                    rows.extend((doc_id, item, 0, 1, own, own) for item, own in here)
                for at in range(0, max(len(whole), 1), BYTES_AT_ONCE):
                    piece = whole[at : at + BYTES_AT_ONCE + reach]
                    pieces.append(piece)
                    ids.append(doc_id)
                    size += len(piece)
                    if size >= BYTES_AT_ONCE:
                        search()
                        pieces, ids, size = [], [], 0
            if pieces:
                search()
            if rows:
                yield dict(zip(names, zip(*rows)))

    return run


def banded_edits(patterns: list[bytes], regions: list[bytes]) -> np.ndarray:
    """Least edits between each pattern and any stretch of its region, by alignment within a band.

    ``cost[c, d]``: edits so far of candidate c on diagonal d. A step down the
    pattern compares, skips a pattern byte (from the diagonal to the right) or
    takes region bytes in between (from those to the left; a running minimum).
    All candidates step together; patterns of one length are aligned together.
    """
    out = np.zeros(len(patterns), np.int64)
    lengths = np.array([len(p) for p in patterns])
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        width = max(max(len(regions[c]) for c in own) - size, 0) + 2 * edit_budget(int(size)) + 1
        pattern = np.array([np.frombuffer(patterns[c], np.uint8) for c in own])
        region = np.zeros((len(own), size + width), np.uint8)
        for row, c in enumerate(own):
            region[row, : len(regions[c])] = np.frombuffer(regions[c], np.uint8)
        slope = np.arange(width)
        cost = np.zeros((len(own), width), np.int64)
        for i in range(size):
            step = cost + (region[:, i : i + width] != pattern[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - slope, axis=1) + slope
        out[own] = cost.min(axis=1)
    return out


def _edits(patterns: pd.Series, regions: pd.Series) -> pd.Series:
    p, r = patterns.tolist(), regions.tolist()
    parts = [banded_edits(p[at : at + ALIGNED_AT_ONCE], r[at : at + ALIGNED_AT_ONCE]) for at in range(0, len(p), ALIGNED_AT_ONCE)]
    return pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, segment, n_segments, edits)``: every segment that a document holds, with its least edits."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    edits = F.pandas_udf(_edits, "long").asNondeterministic()
    found = []
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).toPandas()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast((index(block), short_index(block)))
        seen = map_batches(own, _search(shared), CANDIDATE_SCHEMA)
        checked = seen.withColumn("edits", edits("pattern", "region")).where(F.col("edits") * 100 <= F.octet_length("pattern") * EDIT_PERCENT)
        found.append(stored(checked.select("doc_id", "item_id", "segment", "n_segments", "edits"), "decontaminate-matches"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "item_id", "segment", "n_segments").agg(F.min("edits").alias("edits"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_segments, n_matched, edits)``, one row per document and item found in it."""
    per_item = matches(docs, benchmark).groupBy("doc_id", "item_id")
    return per_item.agg(F.max("n_segments").alias("n_segments"), F.countDistinct("segment").alias("n_matched"), F.sum("edits").alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no segment of the benchmark; same columns."""
    key = fresh_name(docs, "_contaminated_id")
    bad = stored(matches(docs, benchmark).select(F.col("doc_id").alias(key)).distinct(), "decontaminate-ids")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")
