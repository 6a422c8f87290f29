import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from habitnet.llm import packing
from habitnet.llm.encode import Encoder
from pyspark.sql import functions as F
from tests.llm.conftest import PROSE

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
TEXTS = [
    "", " ", "\n\n a  b\n", "it's DON'T  x's we'll", "Ünï 日本 语 x\t\ty \r\n z", "a <|endoftext|> b", "x² ½ Ⅳ _ a_b 12,3.4", PROSE,
    "One. Two!  Three?\n\nFour \n five. ", "\xa0 . a.\xa0b. c", "trailing  ", "'s 's' 'S", "tab\tin. here", "no-break line. x",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_library_s(path):
    enc = Encoder(path)
    for text in TEXTS * 2:  # the second time from what is remembered
        want = enc.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want
        assert np.frombuffer(b"".join(enc.encode_sentences(text)), "<u4").tolist() == want


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_sentences_end_where_the_library_s_offsets_say(path):
    enc = Encoder(path)
    for text in TEXTS:
        got = enc.whole.encode(text, add_special_tokens=False)
        at = [m.start() for m in re.finditer("(?<=[.!?])(?=\\s)|(?<=\\S)(?=\\n)", text)]
        ends = {sum(a < e for a, _ in got.offsets) for e in at} | {len(got.ids)}
        assert enc.encode_with_ends(text)[1].tolist() == sorted(ends - {0})


def cost(ends, penalties, cuts, capacity):
    total, begin = 0, 0
    for c in cuts:
        length = ends[c] - begin
        if length > capacity:
            return float("inf")
        free = length & (length - 1) == 0 and length >= packing.SHORTEST_UNPADDED
        total += (0 if free else capacity - length) + packing.SEQUENCE_COST + penalties[c]
        begin = ends[c]
    return total


def test_windows_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 9)
        ends = np.cumsum([rng.choice([1, 30, 64, 100, 128, 200, 256]) for _ in range(n)])
        penalties = np.array([rng.choice([0, 8, 32]) for _ in range(n)])
        got = packing.windows(ends, penalties, 256)
        every = [[*some, n - 1] for k in range(n) for some in itertools.combinations(range(n - 1), k)]
        assert got[-1] == n - 1
        assert cost(ends, penalties, got, 256) == min(cost(ends, penalties, c, 256) for c in every)


def test_pieces_tile_documents_and_sequences(odd, none):
    enc = Encoder(BYTES)
    rows = [r.asDict() for r in packing.pack(odd, BYTES, 1, 256).collect()]
    want = sorted(enc.whole.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in odd.collect())
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    docs, current, last = [], [], None
    for r in stream:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["start"] == len(current)
        if r["sequence_id"] == last:
            assert r["offset"] == filled
        else:
            assert r["offset"] == 0
        last, filled = r["sequence_id"], r["offset"] + len(ids)
        assert filled <= 256
        current += ids
        if len(current) == r["doc_tokens"]:
            docs.append(current)
            current = []
    assert not current and sorted(docs) == want
    assert packing.pack(none, BYTES, 1).count() == 0


def test_blocks_carry_the_open_window(monkeypatch):
    enc = Encoder(BYTES)
    end = np.array([1], "<u4").tobytes()
    stretch, lengths = packing._Stretch(64), []
    for i in range(40):
        stretch.add(i, enc.encode_sentences(PROSE), end)
        if stretch.size > 300:
            lengths += [sum(len(p[2]) // 4 for p in s) for s in stretch.packed(False)]
    lengths += [sum(len(p[2]) // 4 for p in s) for s in stretch.packed(True)]
    assert sum(lengths) == 40 * (len(enc.whole.encode(PROSE).ids) + 1) and max(lengths) <= 64


def test_little_padding(docs):
    frame = docs([(i, (PROSE + "\n") * (1 + i % 7), "en", "s", 0, 0, "") for i in range(400)])
    sizes = packing.pack(frame.coalesce(1), BYTES, 1).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padding = sum(0 if r["n"] & (r["n"] - 1) == 0 else 2048 - r["n"] for r in sizes)
    assert padding <= 0.1 * sum(r["n"] for r in sizes)
