import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from habitnet.llm import resampling
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import PROSE, rows_of

TARGET = "item_id long, text string, doc_id string, score string"


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, min_words, buckets):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, text in rows:
        n, own = grams(text)
        weight = sum(gain(bucket(g)) for g in own)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def both(spark, docs, rows, target, **options):
    goal = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(target)], TARGET)
    got = resampling.resample(docs(rows).repartition(3), goal, **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute([r[:2] for r in rows], target, options.get("percent", 5), options.get("min_words", 20), options.get("buckets", 10_000))
    return sorted((tuple(r) for r in got.collect()), key=repr), want


@pytest.mark.parametrize("options", [{}, {"percent": 50, "min_words": 2, "buckets": 13}, {"percent": 100, "min_words": 0}])
def test_brute_force(spark, docs, options):
    texts = [PROSE.replace("river", f"river {i % 7} naïve_{i}") * (1 + i % 4) for i in range(60)]
    odd = ["", None, "one", "one two", "One-Two... THREE", "\n\t", "ÀB ÇD", "a" * 5000, "\x00x\x7fy{z}"]
    rows = [*rows_of(*texts, *odd), *rows_of(texts[0], texts[0]), (None, texts[1], None, None, None, None, None)]
    got, want = both(spark, docs, rows, ["the river", None, "", "Farmers meet"], **options)
    assert got == want


def test_odd_and_empty(spark, docs, odd, none):
    rows = [tuple(r) for r in odd.collect()]
    got, want = both(spark, docs, rows, [], percent=50)
    assert got == want  # no target text; the long text whole
    assert both(spark, docs, [], ["some words"])[0] == []
    empty = spark.createDataFrame([], TARGET)
    assert resampling.resample(none, empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text("aB0 .\né東", max_size=30))
def test_spans(text):
    n, own = grams(text)
    words = resampling.words_of(text)
    assert len(words.split()) == n
    assert sorted(resampling.buckets_of(words, 65_536).tolist()) == sorted(zlib.crc32(g.encode()) % 65_536 for g in own)
