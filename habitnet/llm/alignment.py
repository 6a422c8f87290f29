"""Alignment of two tokenizers' tokens over whole texts, and corpus counts of linked ids.

A byte-level BPE file (A, over a blank and the text) and a sentence-piece file
(B, over the text, before which it sets the blank itself) cut the same bytes.
Where tokens of both end, a group ends. The groups are found by *diagonal run
skipping*: at the current index shift between the two arrays of token ends,
stretches of doubling length are compared until one differs, and halves of it
tell where; all tokens before that place pair off one to one. The group there
is resolved token by token up to the next common end, which sets the new shift.

``align`` gives ids and groups of every document. ``link_counts`` aligns and gives, for
each document, its links (pairs of tokens that share bytes) and how many
documents of the whole corpus hold the same two ids linked. Documents are
reduced in the task that aligned them to chunks: a dictionary of the chunk's id
pairs and, per document, places in it. What is shuffled by id pair is one row
per pair and chunk, however often documents hold it, so a pair that all
documents share has as many rows as there are chunks, and the join that brings
the counts back lets AQE split it. A chunk has at most ``CHUNK_ENTRIES``
(document, pair) entries, or those of one document, so no task gathers more.

Defined cases: null and empty texts, and texts that one of the tokenizers does
not keep byte by byte (B's own blank sign U+2581, say), have no tokens and no
links: counts of zero and an empty digest. Special tokens' names inside a text
are plain text. Null doc_ids stay null; rows of one doc_id, and repeated rows,
are documents of their own, each counted. Ties for an id's highest count are
all best. Only the two named columns are read, whatever else there is. An
empty table gives no rows. Texts are never cut; one text's tokens are in memory at once.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from habitnet.llm.common import map_batches, stored, struct_of, texts_of, worker_memo
from habitnet.llm.encode import _SAFE, byte_level

#: Characters of text aligned at a time, unless one text has more.
CHARS_AT_ONCE = 1 << 19
#: (document, id pair) entries of one chunk, unless one document has more.
CHUNK_ENTRIES = 1 << 20
#: Chunks of one partition are numbered within this many bits.
CHUNK_BITS = 33
#: Words that a worker remembers B's ids of, in each of two generations.
REMEMBERED = 150_000
NEAR = 8
BLANK = "\u2581"

ALIGNED = "doc_id long, ids_a binary, ids_b binary, group_ends_a binary, group_ends_b binary"
CHUNKS = (
    "chunk long, keys binary, holders binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "groups_sha256 array<string>, entry_ends binary, entry_keys binary, entry_links binary"
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """The bytes of each id, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return np.empty(0, np.uint8)
        return self.flat[np.repeat(self.begin[ids] - ends + length, length) + np.arange(ends[-1])]


class ByteLevel:
    """A: a byte-level BPE file of the tokenizers library; special tokens' names are plain text.

    Where the file's ids are in merge order, which is looked at on loading,
    tiktoken encodes whole texts to the same ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            tokens, self.fast = byte_level(json.load(f))
        self.vocabulary, self.whole = Vocabulary(tokens), None
        if self.fast is None:
            self.whole = Tokenizer.from_file(path)
            self.whole.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast:
            return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return [np.array(x.ids, "<u4") for x in self.whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """B: a sentence-piece model, which sets a blank before the text itself.

    Where no piece holds a blank behind other characters, nothing is merged
    across a blank, so the words of texts that single blanks separate get the
    ids that they have alone; a worker remembers those of frequent words.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary(
            [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode("utf-8") for i, p in named]
        )
        self.by_word = not any(BLANK in p.lstrip(BLANK) for _, p in named) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str] | None:
        plain = self.by_word and text[:1] != " " and text[-1:] != " " and "  " not in text and _SAFE.fullmatch(text)
        return text.split(" ") if plain else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self._words(t) for t in texts]
        if len(self.recent) > REMEMBERED:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        new = {w for own in words if own for w in own if w not in recent}
        recent.update((w, older[w]) for w in new if w in older)
        missing = [w for w in new if w not in older]
        recent.update(zip(missing, (array("I", ids).tobytes() for ids in self.model.encode(missing, num_threads=1))))
        whole = iter(self.model.encode([t for t, own in zip(texts, words) if own is None], num_threads=1))
        get = recent.__getitem__
        return [np.array(next(whole), "<u4") if own is None else np.frombuffer(b"".join(map(get, own)), "<u4") for own in words]


def _tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    memo, key = worker_memo(), f"aligned:{path_a}:{path_b}"
    if key not in memo:
        memo[key] = ByteLevel(path_a), Pieces(path_b)
    return memo[key]


def diagonal_runs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as token counts of A and of B. Both arrays ascend to the same last end.

    The first ``NEAR`` ends of a stretch are compared one by one, as most stretches are short.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    wide = ends_a.dtype.itemsize
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    n = len(a)
    run, group_a, group_b = [], [], []
    i = j = 0
    while i < n:
        k = 0
        near = min(NEAR, n - i)
        while k < near and a[i + k] == b[j + k]:
            k += 1
        if k == NEAR:
            step = NEAR
            growing = True
            while step:  # stretches at this shift: doubling while they agree, then halving
                p, q = (i + k) * wide, (j + k) * wide
                if raw_a[p : p + step * wide] == raw_b[q : q + step * wide]:
                    k += step
                    if i + k >= n:
                        k = n - i
                        break
                    step = step * 2 if growing else step // 2
                else:
                    growing = False
                    step //= 2
        run.append(k)
        i += k
        if i == n:
            break
        j += k
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        group_a.append(i)
        group_b.append(j)
    runs = np.array(run, np.int64)
    whole = len(group_a)  # the last run may be followed by no group
    many = runs.copy()
    many[:whole] += 1
    last = np.cumsum(many) - 1
    inside = np.arange(int(many.sum())) - np.repeat(last - many + 1, many)
    out = []
    for group in (group_a, group_b):
        begin = np.array([0, *group], np.int64)[: len(runs)]
        cuts = np.repeat(begin, many) + inside + 1
        cuts[last[:whole]] = group
        out.append(cuts)
    return out[0], out[1]


def _spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def _parts(texts: list[str]) -> Iterator[slice]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARS_AT_ONCE:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _aligned(texts: list[str], a: ByteLevel, b: Pieces) -> list[tuple[bytes, bytes, bytes, bytes]]:
    """Per text: ids of A and B and the groups' ends, little-endian unsigned 32-bit."""
    ids = [t.encode(texts) for t in (a, b)]
    raw = [b" " + t.encode("utf-8") if t else b"" for t in texts]
    good = np.array([bool(t) for t in texts], bool)
    flat, counts, spans = [], [], []
    for side, own in zip((a, b), ids):
        flat.append(np.concatenate([*own, np.empty(0, "<u4")]))
        counts.append(np.array([len(x) for x in own], np.int64))
        lengths = side.vocabulary.length[flat[-1]]
        spans.append(lengths)
        per_text = np.add.reduceat(np.append(lengths, 0), _spans(counts[-1])[0]) * (counts[-1] > 0)
        joined = side.vocabulary.join(flat[-1]).tobytes()
        begin, end = _spans(per_text)
        good &= np.array([joined[p:q] == r for p, q, r in zip(begin.tolist(), end.tolist(), raw)], bool)
    kept = [np.repeat(good, n) for n in counts]
    flat = [x[k].astype("<u4") for x, k in zip(flat, kept)]
    counts = [n * good for n in counts]
    ends = [np.cumsum(x[k]).astype("<u4") for x, k in zip(spans, kept)]
    if not len(flat[0]):
        return [(b"",) * 4 for _ in texts]
    cuts = diagonal_runs(*ends)
    out = []
    begins, stops = zip(*map(_spans, counts))
    group_stop = np.searchsorted(cuts[0], stops[0], "right")
    group_begin = np.concatenate([[0], group_stop[:-1]])
    places = [begins[0].tolist(), stops[0].tolist(), begins[1].tolist(), stops[1].tolist(), group_begin.tolist(), group_stop.tolist()]
    for p, q, r, s, g, h in zip(*places):
        own = flat[0][p:q], flat[1][r:s], (cuts[0][g:h] - p).astype("<u4"), (cuts[1][g:h] - r).astype("<u4")
        out.append(tuple(x.tobytes() for x in own))
    return out


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b = _tokenizers(path_a, path_b)
        for batch in batches:
            texts = texts_of(batch)
            for part in _parts(texts):
                done = _aligned(texts[part], a, b)
                columns = zip(*done)
                names = ("ids_a", "ids_b", "group_ends_a", "group_ends_b")
                yield {"doc_id": batch.column("doc_id")[part], **{n: pa.array(c, pa.binary()) for n, c in zip(names, columns)}}

    return run


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def align(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of A and B of every document and, per group, the tokens up to its end on either side.

    All four are little-endian unsigned 32-bit integers; a document without tokens has empty ones.
    """
    return map_batches(_texts(df, doc_id, text), _align(path_a, path_b), ALIGNED)


def _texts_of_groups(path_a: str, path_b: str, size_a: int, size_b: int) -> list[bytes]:
    """What is written for an id of A (0, 1: inside, at the end of its group's ids) and then of B."""
    memo, key = worker_memo(), f"written:{path_a}:{path_b}"
    if key not in memo:
        ends = ((b",", b"|"), (b",", b";"))
        memo[key] = [b"%d%b" % (i, e) for size, pair in zip((size_a, size_b), ends) for i in range(size) for e in pair]
    return memo[key]


class _Flat:
    """The aligned documents of one batch, end to end."""

    def __init__(self, aligned: dict[str, pa.Array]):
        self.doc_id = aligned["doc_id"].to_pylist()
        self.a, self.n_a = self._joined(aligned["ids_a"])
        self.b, self.n_b = self._joined(aligned["ids_b"])
        ends_a, self.n_groups = self._joined(aligned["group_ends_a"])
        ends_b, _ = self._joined(aligned["group_ends_b"])
        self.group_a = ends_a + np.repeat(_spans(self.n_a)[0], self.n_groups)
        self.group_b = ends_b + np.repeat(_spans(self.n_b)[0], self.n_groups)

    @staticmethod
    def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = column.to_pylist()
        return np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array([len(x) // 4 for x in raw], np.int64)

    def digests(self, written: list[bytes], size_a: int) -> list[str]:
        """sha256 of each document's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        in_a, in_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        at_a = np.arange(len(self.a)) + np.repeat(self.group_b - in_b, in_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.group_a, in_b)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.group_a - 1] = 1
        last_b[self.group_b - 1] = 1
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[at_a] = 2 * self.a + last_a
        codes[at_b] = 2 * (size_a + self.b) + last_b
        parts = list(map(written.__getitem__, codes.tolist()))
        begin, end = _spans(self.n_a + self.n_b)
        return [hashlib.sha256(b"".join(parts[p:q])[:-1]).hexdigest() if q > p else "" for p, q in zip(begin.tolist(), end.tolist())]

    def links(self, a: Vocabulary, b: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """``(document, id pair)`` of every link: one for each stretch of bytes that no token's end divides."""
        ends_a, ends_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        if not len(ends_a):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        is_a, is_b = np.zeros(int(ends_a[-1]), bool), np.zeros(int(ends_a[-1]), bool)
        is_a[ends_a - 1] = True
        is_b[ends_b - 1] = True
        at = np.flatnonzero(is_a | is_b)
        token_a, token_b = (np.cumsum(x[at]) - x[at] for x in (is_a, is_b))
        doc = np.repeat(np.arange(len(self.n_a)), self.n_a)[token_a]
        return doc, (self.a[token_a] << 32) | self.b[token_b]


class _Chunk:
    """Documents reduced so far: per batch a dictionary of id pairs and entries that refer to it."""

    def __init__(self):
        self.docs: list[list] = [[], [], [], [], []]
        self.keys, self.entries, self.entry_keys, self.entry_links = [], [], [], []
        self.size = 0

    def add(self, flat: _Flat, digests: list[str], doc: np.ndarray, key: np.ndarray) -> None:
        keys, place = np.unique(key, return_inverse=True)
        entry, links = np.unique(doc * max(len(keys), 1) + place, return_counts=True)
        doc_of = entry // max(len(keys), 1)
        for held, new in zip(self.docs, (flat.doc_id, flat.n_a.tolist(), flat.n_b.tolist(), flat.n_groups.tolist(), digests)):
            held.extend(new)
        self.keys.append(keys)
        self.entries.append(np.bincount(doc_of, minlength=len(flat.n_a)))
        self.entry_keys.append(entry % max(len(keys), 1))
        self.entry_links.append(links)
        self.size += len(entry)

    def row(self, number: int) -> dict:
        keys = np.unique(np.concatenate(self.keys))
        places = np.concatenate([np.searchsorted(keys, own)[e] for own, e in zip(self.keys, self.entry_keys)])
        raw = lambda x, kind: [np.asarray(x).astype(kind).tobytes()]
        names = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
        return {
            "chunk": [number],
            "keys": raw(keys, "<i8"),
            "holders": raw(np.bincount(places, minlength=len(keys)), "<u4"),
            **{n: [held] for n, held in zip(names, self.docs)},
            "entry_ends": raw(np.cumsum(np.concatenate(self.entries)), "<u4"),
            "entry_keys": raw(places, "<u4"),
            "entry_links": raw(np.concatenate(self.entry_links), "<u4"),
        }


def _chunks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b = (t.vocabulary for t in _tokenizers(path_a, path_b))
        written = _texts_of_groups(path_a, path_b, len(a.length), len(b.length))
        number = TaskContext.get().partitionId() << CHUNK_BITS
        chunk = _Chunk()
        for aligned in _align(path_a, path_b)(batches):
            flat = _Flat(aligned)
            chunk.add(flat, flat.digests(written, len(a.length)), *flat.links(a, b))
            if chunk.size >= CHUNK_ENTRIES:
                yield chunk.row(number)
                number, chunk = number + 1, _Chunk()
        if chunk.docs[0]:
            yield chunk.row(number)

    return run


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for chunk, keys, holders in zip(*(batch.column(n).to_pylist() for n in ("chunk", "keys", "holders"))):
            keys = np.frombuffer(keys, "<i8")
            yield {"chunk": np.full(len(keys), chunk), "key": keys, "holders": np.frombuffer(holders, "<u4").astype(np.int64)}


def _counted(chunks: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the corpus counts of its id pairs."""
    order = np.argsort(counts.column("key").to_numpy())
    count = counts.column("count").to_numpy()[order]
    best = counts.column("is_best").to_numpy()[order].astype(np.int64)
    out = {n: [] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
    for row in chunks.to_pylist():  # one: chunks have numbers of their own
        keys, links = np.frombuffer(row["entry_keys"], "<u4"), np.frombuffer(row["entry_links"], "<u4").astype(np.int64)
        ends = np.frombuffer(row["entry_ends"], "<u4").astype(np.int64)
        upto = np.concatenate([[0], ends])
        for name, value in (("n_links", links), ("n_best", links * best[keys]), ("count_sum", links * count[keys])):
            total = np.concatenate([[0], np.cumsum(value)])
            out[name].extend((total[upto[1:]] - total[upto[:-1]]).tolist())
        for name in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"):
            out[name].extend(row[name])
    kinds = {n: pa.string() if n == "groups_sha256" else pa.int64() for n in out}
    return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})


def link_counts(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document, aligned as by ``align``: tokens, groups, links, those whose count is their A id's highest, the counts' sum."""
    chunks = stored(map_batches(_texts(df, doc_id, text), _chunks(path_a, path_b), CHUNKS), "aligned-chunks")
    rows = map_batches(chunks.select("chunk", "keys", "holders"), _key_rows, "chunk long, key long, holders long")
    pairs = stored(rows.groupBy("key").agg(F.sum("holders").alias("count")), "aligned-pairs")
    by_a = pairs.withColumn("a", F.shiftright("key", 32))
    highest = by_a.groupBy("a").agg(F.max("count").alias("highest"))
    marked = by_a.join(highest, "a").select("key", "count", (F.col("count") == F.col("highest")).alias("is_best"))
    found = rows.select("chunk", "key").join(marked, "key")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_counted, struct_of(COUNTED))
