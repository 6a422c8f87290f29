import random

import numpy as np
import pandas as pd
from habitnet.llm import decontaminate as d
from tests.llm.conftest import PROSE

RNG = random.Random(11)


def noise(n):
    return "".join(RNG.choice("abcdefgh ") for _ in range(n))


def least_edits(pattern, text):
    above = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (p != t)))
        above = row
    return min(above)


def edited(text, edits):
    out = bytearray(text)
    for _ in range(edits):
        kind, at = RNG.randrange(3), RNG.randrange(len(out))
        if kind == 0:
            out[at] = RNG.choice(b"abcdefgh")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, RNG.choice(b"abcdefgh"))
    return bytes(out)


def test_every_stretch_within_the_budget_is_found():
    items = [noise(RNG.randint(64, 300)) for _ in range(20)]
    block = d.index(pd.DataFrame({"item_id": range(20), "text": items}))
    for _ in range(200):
        row = RNG.randrange(len(block["rows"]))
        segment = block["rows"][row][2]
        budget = d.edit_budget(len(segment))
        text = noise(RNG.randint(0, 90)).encode() + edited(segment, RNG.randint(0, budget)) + noise(RNG.randint(0, 90)).encode()
        bands = [b for o, b in d.candidates(text, block) if o == row]
        regions = [d.region(text, 0, len(text), b, len(segment)) for b in bands]
        assert regions and min(d.banded_edits([segment] * len(regions), regions)) == least_edits(segment, text)


def test_matches(spark, docs):
    item = " ".join(PROSE.split())
    changed = item.replace("river", "rivor").replace("market", "markt").upper()
    rows = [(1, noise(300) + " " + item + " " + noise(200), *[None] * 5), (2, noise(5000), *[None] * 5), (3, changed, *[None] * 5), (4, item[70:170], *[None] * 5)]
    bench = spark.createDataFrame([(7, item, 1), (8, "too short", 1), (9, None, 1), (None, noise(100), 1)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in d.contaminated(docs(rows), bench).collect()}
    assert set(got) == {(1, 7), (3, 7), (4, 7)}
    assert got[1, 7]["n_matched"] == got[1, 7]["n_segments"] and got[1, 7]["edits"] == 0 and got[3, 7]["edits"] > 0
    assert [r["doc_id"] for r in d.clean(docs(rows), bench).collect()] == [2]


def test_blocks_and_slices_do_not_matter(spark, docs, monkeypatch):
    items = [(i, noise(200)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, noise(400) + items[i % 12][1][30:140] + noise(700), *[None] * 5) for i in range(20)]
    found = lambda: {tuple(r) for r in d.matches(docs(rows), bench).collect()}
    one = found()
    assert {r[0] for r in one} == set(range(20))
    monkeypatch.setattr(d, "BLOCK_BYTES", 500)
    monkeypatch.setattr(d, "BYTES_AT_ONCE", 300)
    assert found() == one


def test_a_neighbour_in_the_batch_is_not_blamed(spark, docs):
    item = noise(90)
    rows = [(i, item if i % 2 else "own words", *[None] * 5) for i in range(40)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in d.contaminated(docs(rows).coalesce(1), bench).collect()} == set(range(1, 40, 2))


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    assert {r["doc_id"] for r in d.contaminated(odd, bench).collect()} == {None, 4}
    assert {r["doc_id"] for r in d.clean(odd, bench).collect()} == {1, 2, 3, 5, 6} and d.clean(odd, bench).columns == odd.columns
    assert d.clean(odd, bench.limit(0)).count() == odd.count() and d.contaminated(none, bench).count() == 0


def test_an_excerpt_is_found_wherever_it_begins(spark, docs):
    item = "".join(RNG.choice("abcdefgh") for _ in range(400))
    rows = [(at, noise(100) + item[at : at + 64] + noise(100), *[None] * 5) for at in range(400 - 64 + 1)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in d.contaminated(docs(rows), bench).collect()} == set(range(400 - 64 + 1))


def test_short_items_are_found_as_whole_words(spark, docs, monkeypatch):
    rows = [(1, "So: Two  RIVERS meet, here", *[None] * 5), (2, "two riversides meet", *[None] * 5), (3, "no", *[None] * 5), (4, "ono nos", *[None] * 5), (5, "", *[None] * 5)]
    bench = spark.createDataFrame([(7, "Two rivers meet"), (8, "no"), (9, ""), (None, "so")], "item_id long, text string")
    want = {(1, 7), (3, 8), (1, None)}
    found = lambda: {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs(rows), bench).collect()}
    assert found() == want
    monkeypatch.setattr(d, "BYTES_AT_ONCE", 5)
    assert found() == want
    assert {r["doc_id"] for r in d.clean(docs(rows), bench).collect()} == {2, 4, 5}


def test_isolated_grams_are_not_expanded():
    """Places that share a q-gram by chance go before they meet all segments that hold it; a stretch with enough stays whole."""
    rng = np.random.default_rng(5)
    for many, width in ((1, 85), (9, 85), (17, 85), (17, 20), (500, 85)):
        at = np.flatnonzero(rng.random(3000) < np.repeat(rng.choice([0.02, 0.2, 0.6], 30), 100))
        want = [any(s <= i < s + many for s in range(len(at) - many + 1) if at[s + many - 1] - at[s] < width) for i in range(len(at))]
        assert d._crowded(at, many, width).tolist() == want
    assert d._crowded(np.zeros(0, np.int64), 17, 85).tolist() == []
    item = bytes(rng.integers(97, 123, 200).astype(np.uint8))
    block = d.index(pd.DataFrame({"item_id": [1], "text": [item.decode()]}))
    edited = item[20:52] + b"x" + item[53:84]
    assert {n for n, _ in d.candidates(b"." * 300 + edited + b"." * 300, block)} >= {3}  # bytes 24 to 88
    assert not list(d.candidates(b"................".join(item[p : p + 9] for p in range(0, 180, 9)), block))
