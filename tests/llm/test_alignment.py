import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from habitnet.llm import alignment
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import PROSE, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: The byte-level alphabet: printable bytes as they are, the others from U+0100 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def tokens(text):
    """``[(id, bytes)]`` by A and by B, by the libraries alone."""
    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    a = [(i, bytes(BYTE_OF[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in s.encode(text):
        p = s.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()))
    return a, b


def brute(rows):
    held, links_of, out = Counter(), [], []
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            links_of.append([])
            out.append([doc_id, 0, 0, 0, ""])
            continue
        spans = []
        for side in (a, b):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append([(e - len(x), e, i) for (i, x), e in zip(side, ends)])
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], 0
        for e in common:
            own = [",".join(str(i) for p, q, i in side if at <= p and q <= e) for side in spans]
            groups.append("|".join(own))
            at = e
        links = [(i, j) for p, q, i in spans[0] for r, s, j in spans[1] if max(p, r) < min(q, s)]
        links_of.append(links)
        held.update(set(links))
        out.append([doc_id, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (d, a, b, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha)
        for (d, a, b, g, sha), links in zip(out, links_of)
    ]


TEXTS = [
    PROSE, PROSE.upper(), "", None, " ", "  two  blanks ", "a▁b", "naïve café — 東京は \U0001f600\U0001f600", "<s> </s> <unk> <0x0A> <|endoftext|>",
    "\x00\x01 control", "tab\tand\nline\r\n", "1234567890 12.5%", "internationalisation antidisestablishmentarianism", "ÀÉÎ", "x" * 300,
]


def flat(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_brute_force(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_ENTRIES", chunk)
    monkeypatch.setattr(alignment, "CHARS_AT_ONCE", 60 if chunk == 1 else 2 << 20)
    rows = [*rows_of(*TEXTS), *rows_of(PROSE, PROSE), (None, "no id here", None, None, None, None, None)]
    got = alignment.link_counts(docs(rows).repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert flat(got.collect()) == flat(brute([r[:2] for r in rows]))


def test_groups_of_align(docs):
    rows = rows_of(*TEXTS)
    for got, (doc_id, text) in zip(alignment.align(docs(rows).coalesce(1), A, B).collect(), [r[:2] for r in rows]):
        ids = [np.frombuffer(got[c], "<u4") for c in ("ids_a", "ids_b", "group_ends_a", "group_ends_b")]
        assert got["doc_id"] == doc_id and len(ids[2]) == len(ids[3])
        if len(ids[0]):
            a, b = tokens(text)
            assert (ids[0].tolist(), ids[1].tolist()) == ([i for i, _ in a], [i for i, _ in b])
            assert (ids[2][-1], ids[3][-1]) == (len(a), len(b))
            for p, q, r, s in zip([0, *ids[2][:-1]], ids[2], [0, *ids[3][:-1]], ids[3]):
                assert b"".join(x for _, x in a[p:q]) == b"".join(x for _, x in b[r:s])


def test_a_file_that_tiktoken_cannot_read(tmp_path, monkeypatch):
    """Another split in the file: the tokenizers library encodes; a model that merges across blanks is not encoded by word."""
    import json

    spec = json.load(open(A))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    own = alignment.ByteLevel(str(tmp_path / "other.json"))
    assert own.fast is None and own.encode(["ab c"])[0].tolist() == alignment.ByteLevel(A).encode(["ab c"])[0].tolist()
    pieces = alignment.Pieces(B)
    assert pieces.by_word
    want = [x.tolist() for x in pieces.encode([PROSE, "a b  c"])]
    pieces.by_word = False
    assert [x.tolist() for x in pieces.encode([PROSE, "a b  c"])] == want


def test_odd_and_empty(odd, none):
    got = alignment.link_counts(odd, A, B).collect()
    assert len(got) == odd.count()
    long = next(r for r in got if r["doc_id"] == 5)
    a, b = tokens(next(r["text"] for r in odd.collect() if r["doc_id"] == 5))
    assert (long["n_a"], long["n_b"]) == (len(a), len(b))  # the whole text
    assert alignment.link_counts(none, A, B).collect() == [] and alignment.align(none, A, B).collect() == []


def test_hot_pair_rows(docs):
    """A pair that all documents hold has one row per chunk, not one per document."""
    frame = docs(rows_of(*["the same words"] * 500)).coalesce(1)
    made = alignment.map_batches(frame.select("doc_id", "text"), alignment._chunks(A, B), alignment.CHUNKS).collect()
    assert len(made) == 1 and len(made[0]["keys"]) // 8 < 10
    assert np.frombuffer(made[0]["holders"], "<u4").tolist() == [500] * (len(made[0]["keys"]) // 8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.integers(0, 2)), min_size=1, max_size=12))
def test_diagonal_runs(parts):
    a, b = [], []
    for own, kind in parts:  # stretches cut alike, merged on one side, or not at all on the other
        a += own
        b += own if kind == 0 else [sum(own)] if kind == 1 else [1] * sum(own)
    ends_a, ends_b = np.cumsum(a).astype("<u4"), np.cumsum(b).astype("<u4")
    common = np.intersect1d(ends_a, ends_b)
    for x, y in ((ends_a, ends_b), (ends_b, ends_a)):
        got = alignment.diagonal_runs(x, y)
        assert got[0].tolist() == (np.searchsorted(x, common) + 1).tolist()
        assert got[1].tolist() == (np.searchsorted(y, common) + 1).tolist()
