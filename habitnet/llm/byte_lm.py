"""Language-model scoring by context-tree weighting over bytes.

A text is the stream of its words (A-Z in lower case), joined by blanks and
closed by an end byte. Every byte is coded bit by bit, so a node of the tree is
a context of up to ``DEPTH`` bytes together with the bits of the current byte
that are known. Each node holds how often 0 and 1 followed there in the
training documents, and gives the Krichevsky-Trofimov estimate; a node's
weighted probability of the training data is half its own estimate's and half
the product of its children's. The code for a new bit mixes the estimates of
all nodes on the path, each by its share in that weighting; where a path leaves
the tree, what weight is left goes to the deepest node reached.

The tree depends on the counts of byte grams only (``DEPTH`` + 1 bytes), and a
gram's code length is the same wherever it stands. So Spark counts grams over
all documents and groups them by their last ``SPLIT`` bytes of context; tasks
build the subtrees below, grouped sums the levels above, and grams get their
code lengths on the way down. Documents are cut into chunks of ``CHUNK_BYTES``, and
each chunk gets a dictionary of the words that occur in it; of grams too, if
there are too many of them (``SENT_GRAMS``) to send all to every worker.

Defined cases: a null text is the empty text (its end only); repeated rows are
scored one by one; null doc_ids count as training documents if their remainder
(that of 0) says so; without training documents every count is zero and each
bit has probability one half. A NUL byte in a text counts like an end. An
empty table gives no rows; texts are scored whole; scores need no order, so ties mean nothing.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitnet.llm.common import map_batches, stored, struct_of, texts_of
from habitnet.llm.labelled import fold

DEPTH = 5
FOLDS = 5
HELD_OUT_FOLD = 1
CHUNK_BYTES = 24 << 20
#: Contexts of this many bytes are where the tree is split: whole subtrees below in tasks, grouped sums above.
SPLIT = 2
#: Grams whose subtrees are built at a time (more if they share a context of SPLIT bytes).
GRAMS_AT_ONCE = 1 << 18
#: Bytes whose grams are looked up at a time.
BYTES_AT_ONCE = 1 << 20
#: As many grams (16 bytes each) are sent to every worker; of more, each chunk gets those that occur in it.
SENT_GRAMS = 4_000_000
#: Chunks of one partition are numbered below 2^20.
CHUNK_BITS = 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

STREAM_SCHEMA = "chunk long, doc_id long, held_out boolean, stream binary"
SCORES_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def stream(text: str) -> bytes:
    """The words of a text, A-Z in lower case, joined by blanks."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    chunk, size = TaskContext.get().partitionId() << CHUNK_BITS, 0
    for batch in batches:
        own, numbers = [stream(t) for t in texts_of(batch)], []
        for s in own:
            if size and size + len(s) > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            size += len(s) + 1
            numbers.append(chunk)
        yield {"chunk": numbers, "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "stream": own}


def streams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    held = own.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"), "text")
    return map_batches(held, _streams, STREAM_SCHEMA)


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """Runs of one chunk's documents, at most ``CHUNK_BYTES`` each (and one document)."""
    number, texts, held, size = None, [], [], 0
    for batch in batches:
        for c, s, h in zip(batch.column("chunk").to_pylist(), batch.column("stream").to_pylist(), batch.column("held_out").to_pylist()):
            if texts and (c != number or size > CHUNK_BYTES):
                yield number, texts, held
                texts, held, size = [], [], 0
            number = c
            texts.append(s)
            held.append(h)
            size += len(s)
    if texts:
        yield number, texts, held


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for chunk, texts, held in _by_chunk(batches):
        counts: Counter = Counter()
        for s, h in zip(texts, held):
            tokens = [*s.split(), b""]
            if h:
                for t in tokens:
                    if t not in counts:
                        counts[t] = 0
            else:
                counts.update(tokens)
        yield {"chunk": [chunk] * len(counts), "token": list(counts), "n": list(counts.values())}


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts (each closed by its end) with the ``DEPTH`` before it, the byte lowest; where texts begin.

    Before a text's first byte stand zeros.
    """
    pad = bytes(DEPTH)
    raw = np.frombuffer(pad + (b"\0" + pad).join(texts) + b"\0", np.uint8).astype(np.int64)
    gram = raw[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        gram |= raw[DEPTH - back : len(raw) - back] << (8 * back)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(lengths) - lengths
    keep = np.ones(len(gram), bool)
    for i in range(DEPTH):
        keep[(begins + DEPTH * np.arange(len(texts)))[1:] - DEPTH + i] = False
    return gram[keep], begins


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for s in texts:
        block.append(s)
        size += len(s)
        if size >= BYTES_AT_ONCE:
            yield block
            block, size = [], 0
    if block:
        yield block


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for chunk, texts, held in _by_chunk(batches):
        parts = []
        for weight, own in ((1, [s for s, h in zip(texts, held) if not h]), (0, [s for s, h in zip(texts, held) if h])):
            for block in _blocks(own):
                keys, n = np.unique(byte_grams(block)[0], return_counts=True)
                parts.append((keys, weight * n))
        keys, n = _summed(parts)
        yield {"chunk": np.full(len(keys), chunk), "gram": keys, "n": n}


def _log_gamma(x):
    """Stirling's series at x + 8, brought back to x (of columns or arrays)."""
    log = F.log if isinstance(x, Column) else np.log
    y = x + 8.0
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - log(product)


def log_kt(zeros, ones):
    """Log of the Krichevsky-Trofimov estimate of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _nodes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight rows: each gram's deepest nodes (context, then the bits known after a leading 1), and the next bit."""
    byte = gram & 255
    keys = [((gram >> 8) << 8) | (1 << k) | (byte >> (8 - k)) for k in range(8)]
    return np.array(keys).reshape(8, -1), np.array([(byte >> (7 - k)) & 1 for k in range(8)]).reshape(8, -1)


def _subtree(gram: np.ndarray, n: np.ndarray) -> list[dict]:
    """Levels ``DEPTH`` to ``SPLIT`` over whole contexts of ``SPLIT`` bytes; ``of``: each lower node's (or gram bit's) node."""
    keys, bits = _nodes(gram)
    counts = np.broadcast_to(n, keys.shape).ravel().astype(float)
    levels: list[dict] = []
    below, zeros, ones, inside = keys.ravel(), counts * (1 - bits.ravel()), counts * bits.ravel(), None
    for depth in range(DEPTH, SPLIT - 1, -1):
        if depth < DEPTH:
            below = ((below >> 8 & ((1 << 8 * depth) - 1)) << 8) | (below & 255)
        key, of = np.unique(below, return_inverse=True)
        of = of.ravel()
        zeros, ones = np.bincount(of, zeros, len(key)), np.bincount(of, ones, len(key))
        kt = log_kt(zeros, ones)
        weighted = kt if inside is None else np.logaddexp(kt, np.bincount(of, inside, len(key))) - math.log(2)
        levels.append({"key": key, "of": of, "zeros": zeros, "ones": ones, "kt": kt, "weighted": weighted})
        below, inside = key, weighted
    return levels


def _whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of sorted rows in blocks that end where a context of ``SPLIT`` bytes does."""
    gram, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        gram = np.concatenate([gram, batch.column("gram").to_numpy()])
        n = np.concatenate([n, batch.column("n").to_numpy()])
        if len(gram) >= GRAMS_AT_ONCE:
            context = gram >> 8 & ((1 << 8 * SPLIT) - 1)
            cut = int(np.flatnonzero(context != context[-1])[-1]) + 1 if context[0] != context[-1] else 0
            if cut:
                yield gram[:cut], n[:cut]
                gram, n = gram[cut:], n[cut:]
    if len(gram):
        yield gram, n


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for gram, n in _whole_contexts(batches):
        top = _subtree(gram, n)[-1]
        yield {"context": top["key"] >> 8, "known": (top["key"] & 255).astype(np.int32)} | {c: top[c] for c in ("zeros", "ones", "kt", "weighted")}


def _step(seen, estimate, share, mixed, left, own, where):
    """One node further down a path: what the nodes so far add, the weight left, the deepest seen node's estimate."""
    return where(seen, mixed + left * share * estimate, mixed), where(seen, left * (1 - share), left), where(seen, estimate, own)


def _lengths(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys, *state = shared.value
        for gram, n in _whole_contexts(batches):
            levels = _subtree(gram, n)[::-1]
            at = np.searchsorted(keys, levels[0]["key"])
            mixed, left, own = (x[at] for x in state)
            for above, level in zip(levels, levels[1:]):
                total = level["zeros"] + level["ones"]
                share = np.exp(level["kt"] - level["weighted"] - math.log(2)) if level is not levels[-1] else 1.0
                to = above["of"]
                mixed, left, own = _step(total > 0, (level["ones"] + 0.5) / (total + 1), share, mixed[to], left[to], own[to], np.where)
            one = (mixed + left * own)[levels[-1]["of"]].reshape(8, -1)
            yield {"gram": gram, "value": np.log10(np.where(_nodes(gram)[1] == 1, one, 1 - one)).sum(axis=0)}

    return run


def _paths(tops: DataFrame) -> DataFrame:
    """``(context, known, mixed, left, own)`` of the nodes of depth ``SPLIT``: up from them to the root, and down again."""
    levels, kt = {SPLIT: tops}, log_kt(F.col("zeros"), F.col("ones"))
    for depth in range(SPLIT - 1, -1, -1):
        below = levels[depth + 1].groupBy(F.col("context").bitwiseAND((1 << 8 * depth) - 1).alias("context"), "known")
        own = below.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children")).withColumn("kt", kt)
        larger, smaller = F.greatest("kt", "children"), F.least("kt", "children")
        levels[depth] = stored(own.withColumn("weighted", larger + F.log1p(F.exp(smaller - larger)) - math.log(2)).drop("children"), "lm-level")
    total = F.col("zeros") + F.col("ones")
    share, estimate = F.exp(F.col("kt") - F.col("weighted") - math.log(2)), (F.col("ones") + 0.5) / (total + 1.0)
    where = lambda test, yes, no: F.when(test, yes).otherwise(no)
    path = levels[0].select(F.lit(0).cast("long").alias("parent"), "known", F.lit(0.0).alias("mixed"), F.lit(1.0).alias("left"), F.lit(0.5).alias("own"))
    for depth in range(SPLIT + 1):
        level = levels[depth].withColumn("parent", F.col("context").bitwiseAND((1 << 8 * max(depth - 1, 0)) - 1))
        mixed, left, own = _step(total > 0, estimate, share, F.col("mixed"), F.col("left"), F.col("own"), where)
        found = level.join(path, ["parent", "known"]).select("context", "known", mixed.alias("mixed"), left.alias("left"), own.alias("own"))
        path = found.withColumnRenamed("context", "parent")
    return path.withColumnRenamed("parent", "context")


def code_lengths(grams: DataFrame) -> DataFrame:
    """``(gram, value)``: the log10 probability of a gram's last byte after the others.

    ``grams`` has a row ``(gram, n)`` for every gram to be coded, n zero for
    those that training hasn't seen.
    """
    near = F.shiftright("gram", 8).bitwiseAND((1 << 8 * SPLIT) - 1).alias("near")
    grouped = grams.select("gram", "n", near).repartition("near").sortWithinPartitions("near", "gram").select("gram", "n")
    tops = stored(map_batches(grouped, _tops, "context long, known int, zeros double, ones double, kt double, weighted double"), "lm-tops")
    rows = _paths(tops).toPandas()  # 2^(8 SPLIT) x 255 rows at most, one for each context of SPLIT bytes and known bits that occur
    key = rows["context"].to_numpy(np.int64) << 8 | rows["known"].to_numpy(np.int64)
    order = np.argsort(key)
    state = (key[order], *[rows[c].to_numpy(float)[order] for c in ("mixed", "left", "own")])
    return map_batches(grouped, _lengths(grams.sparkSession.sparkContext.broadcast(state)), "gram long, value double")


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys. Asked in order, the search stays where the last one ended; else each is a walk through all keys."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), values.dtype)
    out[order] = values[np.searchsorted(keys, wanted[order])]
    return out


def _score_chunk(shared):
    """Scores of a chunk's documents from its dictionary; grams come from ``shared`` if it isn't None."""

    def run(docs: pa.Table, entries: pa.Table) -> pa.Table:
        own = entries.column("token").is_valid()
        tokens = entries.filter(own)
        known = dict(zip(tokens.column("token").to_pylist(), tokens.column("value").to_pylist()))
        if shared is None:
            grams = entries.filter(pa.compute.invert(own))
            keys, where = np.unique(grams.column("gram").to_numpy(), return_index=True)  # a chunk read in two parts counts twice
            values = grams.column("value").to_numpy()[where]
        else:
            keys, values = shared.value
        texts = docs.column("stream").to_pylist()
        scores: list[np.ndarray] = []
        for block in _blocks(texts):
            gram, begins = byte_grams(block)
            scores.append(np.add.reduceat(_looked_up(keys, values, gram), begins))
        n_tokens, n_known, base = [], [], []
        for s in texts:
            found = [*s.split(), b""]
            logs = np.fromiter(map(known.__getitem__, found), float, len(found))
            n_tokens.append(len(found))
            n_known.append(int(np.count_nonzero(logs > 0)))
            base.append(float(logs.sum()))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_sum": pa.array(base, pa.float64()),
                "score": pa.array(np.concatenate(scores) if scores else [], pa.float64()),
            }
        )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    grams, values = [], []
    for batch in batches:
        grams.append(batch.column("gram").to_numpy().tobytes())
        values.append(batch.column("value").to_numpy().tobytes())
    yield {"grams": [b"".join(grams)], "lengths": [b"".join(values)]}


def _sent(lengths: DataFrame):
    """All grams, sorted, with their code lengths, for every worker; they come as one row of bytes from each task."""
    rows = map_batches(lengths, _packed, "grams binary, lengths binary").collect()
    grams = np.concatenate([np.frombuffer(r["grams"], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    values = np.concatenate([np.frombuffer(r["lengths"], float) for r in rows] or [np.zeros(0)])
    order = np.argsort(grams)
    return lengths.sparkSession.sparkContext.broadcast((grams[order], values[order]))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document."""
    cut = stored(streams(docs, doc_id, text), "lm-streams")
    slim = cut.select("chunk", "held_out", "stream")
    every = Window.partitionBy("token")
    tokens = map_batches(slim, _count_tokens, "chunk long, token binary, n long")
    tokens = stored(
        tokens.select("chunk", "token", F.sum("n").over(every).alias("c"), (F.row_number().over(every.orderBy("chunk")) == 1).alias("first")),
        "lm-tokens",
    )
    total = tokens.where("first").agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    train_tokens, vocabulary = total[0] or 0, total[1]
    in_chunks = map_batches(slim, _count_grams, "chunk long, gram long, n long")
    grams = stored(in_chunks.groupBy("gram").agg(F.sum("n").alias("n")), "lm-gram-counts")
    lengths = stored(code_lengths(grams), "lm-code-lengths")
    entries = tokens.select("chunk", "token", F.lit(None).cast("long").alias("gram"), F.log10(F.col("c") + 0.5).alias("value"))
    shared = _sent(lengths) if lengths.count() <= SENT_GRAMS else None
    if shared is None:
        there = in_chunks.select("chunk", "gram").join(lengths, "gram")
        entries = entries.unionByName(there.select("chunk", F.lit(None).cast("binary").alias("token"), "gram", "value"))
    scored = cut.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(_score_chunk(shared), struct_of(SCORES_SCHEMA))
    norm = math.log10(train_tokens + 0.5 * (vocabulary + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * norm).alias("base_score"), "score",
    )
