"""Order-preserving packing of documents into sequences of fixed length.

The documents' ids, in ascending order of doc_id, form a stream. Windows are
cut from it at document or sentence ends by dynamic programming: the cost of a
window is its padding, a fixed cost per sequence and the penalty of the cut
that ends it (none at a document's end). As padding is linear in the window's
start, the best start among all within reach is the minimum of a sliding
window, kept in a monotone queue. Windows whose length is a power of two are
not padded; those of at least ``SHORTEST_UNPADDED`` ids are tried beside the
queue's candidate. Sentences of more than
``LONG_SENTENCE`` ids may also be cut every that many ids, at a higher penalty.

Spark range-partitions the documents; each partition packs its own stretch in
blocks of ``BLOCK`` ids and carries the unfinished last window on to the next
block, so memory depends on the block and the longest document only.

Defined cases: a null text is the empty text (its end id only); null doc_ids
come first; rows of one doc_id are packed one by one, ordered by a hash of
their texts; an empty table gives no rows. Texts are packed
whole, cut into as many pieces as needed; of equally cheap cuts the first one is taken. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from habitnet.llm.common import map_batches, texts_of
from habitnet.llm.encode import encoder
from habitnet.llm.token_files import by_id

BLOCK = 1 << 19
LONG_SENTENCE = 256
SEQUENCE_COST = 8
SENTENCE_PENALTY = 8
MID_PENALTY = 32
#: Shorter windows waste a sequence, padded or not.
SHORTEST_UNPADDED = 128
#: Sequence numbers of one partition lie within 2^33 of each other.
SEQUENCE_BITS = 33

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def windows(ends: np.ndarray, penalties: np.ndarray, capacity: int) -> list[int]:
    """The cheapest cuts of a stream: indexes into ``ends``, the last one included.

    ``ends`` are the ascending places where a cut may be (no two further apart
    than ``capacity``, the first within it); ``penalties`` what a cut costs.
    """
    place = [0, *ends.tolist()]
    grid = np.array(place)
    exempt: dict[int, list[int]] = {}
    length = SHORTEST_UNPADDED
    while length < capacity:
        before = np.searchsorted(grid, grid - length)
        for j in np.flatnonzero((grid >= length) & (grid[before] == grid - length)).tolist():
            exempt.setdefault(j, []).append(int(before[j]))
        length *= 2
    cost, came = [0] * len(place), [0] * len(place)
    queue: deque = deque([(0, 0)])  # (cost + place, index), rising
    for j, penalty in enumerate(penalties.tolist(), 1):
        here = place[j]
        while place[queue[0][1]] < here - capacity:
            queue.popleft()
        best, came[j] = queue[0][0] + capacity - here, queue[0][1]
        if j in exempt:
            for i in exempt[j]:
                if cost[i] < best:
                    best, came[j] = cost[i], i
        cost[j] = best + penalty + SEQUENCE_COST
        value = cost[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(j - 1)
        j = came[j]
    return cuts[::-1]


class _Stretch:
    """Documents (or their rests) that are not yet packed."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.docs: list[list] = []  # [doc_id, ids, first id not packed, ends of parts]
        self.size = 0

    def add(self, doc_id, parts: list[bytes], end: bytes) -> None:
        parts = [p for p in parts if p]
        parts = [*parts[:-1], parts[-1] + end] if parts else [end]
        ids = np.frombuffer(b"".join(parts), "<u4")
        self.docs.append([doc_id, ids, 0, np.cumsum([len(p) // 4 for p in parts])])
        self.size += len(ids)

    def _cuts(self) -> tuple[np.ndarray, np.ndarray]:
        ends, penalties, base = [], [], 0
        for _, ids, first, parts in self.docs:
            parts = parts[parts > first]
            lengths = np.diff(parts, prepend=first)
            if (lengths > LONG_SENTENCE).any():
                inner = np.concatenate([np.arange(b - n + LONG_SENTENCE, b, LONG_SENTENCE) for b, n in zip(parts, lengths)])
                every = np.concatenate([parts, inner])
                cost = np.concatenate([np.full(len(parts), SENTENCE_PENALTY), np.full(len(inner), MID_PENALTY)])
                cost[len(parts) - 1] = 0
                order = np.argsort(every, kind="stable")
                every, cost = every[order], cost[order]
            else:
                every, cost = parts, np.full(len(parts), SENTENCE_PENALTY)
                cost[-1] = 0
            ends.append(every + (base - first))
            penalties.append(cost)
            base += len(ids) - first
        return np.concatenate(ends), np.concatenate(penalties)

    def packed(self, last: bool) -> Iterator[list[tuple]]:
        """The pieces of each finished sequence; the last window stays unless ``last``."""
        if not self.docs:
            return
        ends, penalties = self._cuts()
        stops = ends[windows(ends, penalties, self.capacity)].tolist()
        if not last:
            stops.pop()
        at, base = 0, 0  # the document, and where in the stretch its first unpacked id stands
        begin = 0
        for stop in stops:
            pieces = []
            while begin < stop:
                doc = self.docs[at]
                take = min(stop, base + len(doc[1]) - doc[2]) - begin
                pieces.append((doc[0], doc[2], doc[1][doc[2] : doc[2] + take].tobytes(), len(doc[1])))
                doc[2] += take
                begin += take
                base = begin
                if doc[2] == len(doc[1]):
                    at += 1
            yield pieces
        self.docs = self.docs[at:]
        self.size = sum(len(d[1]) - d[2] for d in self.docs)


def _rows(sequences: Iterator[list[tuple]], first: int) -> tuple[dict, int]:
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    out: dict[str, list] = {n: [] for n in names}
    for number, pieces in enumerate(sequences, first):
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for name, value in zip(names, (doc_id, start, n, total, number, offset, ids)):
                out[name].append(value)
            offset += n
        first = number + 1
    return out, first


def _pack(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc, stretch = encoder(path), _Stretch(capacity)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                stretch.add(doc_id, enc.encode_sentences(text), end)
                if stretch.size >= BLOCK:
                    rows, number = _rows(stretch.packed(False), number)
                    yield rows
        rows, number = _rows(stretch.packed(True), number)
        yield rows

    return run


def pack(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence, with its ids (little-endian, unsigned 32 bits).

    ``sequence_id`` ascends with the stream; it is not gapless.
    """
    return map_batches(by_id(df, doc_id, text), _pack(tokenizer, end_id, capacity), SCHEMA)
