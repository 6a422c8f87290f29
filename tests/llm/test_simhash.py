import random

import xxhash
from habitnet.llm import simhash
from tests.llm.conftest import PROSE, rows_of


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """Least index reachable over pairs of at most three differing bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint_is_the_plain_one():
    for text in ["", " ", "One", "one TWO", "a b c", "A b C d e f", PROSE, "É é Ä a\x0bb"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_views_leave_one_difference_at_most():
    keep = [set(v) for v in simhash.views()]
    rng = random.Random(1)
    for _ in range(2000):
        bits = rng.sample(range(64), 3)
        assert any(len(v & set(bits)) <= 1 for v in keep)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(2)
    values = [0, (1 << 64) - 1]
    for _ in range(40):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(rng.randrange(6)):  # chains and near misses of up to five bits
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            values.append(base)
    values = list(dict.fromkeys(values))
    signed = [(i, i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    found = simhash.components(spark.createDataFrame(signed, "doc_id long, text_hash long, fp long"))
    got = {r["fp"] % (1 << 64): r["component_id"] for r in found.collect()}
    assert [got[v] for v in values] == plain_components(values)


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["fp"] == 0, r["component_id"]))
    assert by_id[1] == by_id[2] == by_id[3] == {(True, 1)}  # no words: fingerprint zero, least id 1
    assert (True, 1) in by_id[None] and (False, 4) in by_id[None]
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each(odd, none, docs):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted(((r["doc_id"] or -1), len(r["text"] or "")) for r in kept.collect())
    groups = simhash.components(simhash.fingerprints(odd)).select("root").distinct().count()
    assert len(got) == groups  # one row for each, the repeated row once
    assert simhash.one_of_each(none).count() == 0
    same = docs(rows_of(*[PROSE] * 50))
    assert [r["doc_id"] for r in simhash.one_of_each(same).collect()] == [0]
