from collections import Counter

import pytest
from habitnet.llm import quality_rules as q
from tests.llm.conftest import PROSE, rows_of


def plain_repeats(words, k=8):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    often = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(k)})


@pytest.mark.parametrize("text", ["", "a", "a " * 8, "a " * 9, "a b " * 20, "x y z " + "1 2 3 4 5 6 7 8 " * 2 + "q", PROSE + " " + PROSE])
def test_repeated_words(text):
    assert q.repeated_window_words(text.split()) == plain_repeats(text.split())


@pytest.mark.parametrize(
    "line, fails",
    [
        ("The river runs past the old mill and turns west.", False),
        ("Home | Login | Search | Contact us | About us", True),
        ("BUY!! NOW!! CHEAP!! HERE!!", True),
        ("word### other*** thing%%% more$$$", True),
        ("far far far far far near near near near near", True),
        ("All rights reserved.", True),
        ("She went home.", False),
        ("home login menu", True),
    ],
)
def test_lines(line, fails):
    assert q.line_fails(line, line.encode().split()) is fails


def test_documents(docs):
    junk = "\n".join(["Home | Login | Search"] * 3)
    rows = rows_of(PROSE, PROSE + "\n" + junk, "short text", "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(9)))
    frame = docs(rows)
    kept = {r["doc_id"]: r for r in q.clean(frame).collect()}
    assert set(kept) == {0, 1} and kept[1]["text"] == PROSE and kept[0]["n_words"] == "x"
    got = {r["doc_id"]: r for r in q.report(frame).collect()}
    assert got[1]["n_dup_lines"] == 2 and got[1]["n_symbols"] == 6 and not got[2]["kept"] and got[2]["base_failed"]
    assert not got[3]["base_failed"] and not got[3]["kept"]


def test_odd_rows(odd, none):
    got = q.report(odd)
    assert got.count() == odd.count()
    assert [tuple(r)[1:8] for r in got.where("doc_id IN (1, 2, 3)").collect()] == [(0, 0, 0, 0, 0, True, False)] * 3
    assert q.clean(odd).columns == odd.columns and q.clean(none).count() == 0 and q.report(none).count() == 0
