import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from habitnet.llm import byte_lm
from tests.llm.conftest import PROSE, rows_of

D = byte_lm.DEPTH


def coded(text):
    """The path of nodes and the bit, for every bit of a text."""
    s = bytes(D) + byte_lm.stream(text) + b"\0"
    for i in range(D, len(s)):
        for k in range(8):
            known = (1 << k) | (s[i] >> (8 - k))
            yield [(s[i - d : i], known) for d in range(D + 1)], s[i] >> (7 - k) & 1


def plain(train, texts):
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        for path, bit in coded(t):
            for d, node in enumerate(path):
                counts[node][bit] += 1
                if d:
                    children[path[d - 1]].add(node)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = kt(*counts[node])
        weighted[node] = own if len(node[0]) == D else np.logaddexp(own, sum(weighted[c] for c in children[node])) - math.log(2)
    out = []
    for t in texts:
        total = 0.0
        for path, bit in coded(t):
            p, left, last = 0.0, 1.0, 0.5
            for d, node in enumerate(path):
                if node not in counts:
                    break
                last = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
                share = 1.0 if d == D else math.exp(kt(*counts[node]) - weighted[node] - math.log(2))
                p, left = p + left * share * last, left * (1 - share)
            p += left * last
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_scores_and_base(docs, monkeypatch):
    texts = [PROSE, PROSE.upper(), "", None, "the river runs", "QUITE other wordS é日 here", "the the the", "\x00 odd\x0bbytes", PROSE[:60], "bridge mill"]
    frame = docs(rows_of(*texts))
    got = sorted(byte_lm.score(frame.repartition(3)).collect(), key=lambda r: r["doc_id"])
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    assert [r["held_out"] for r in got] == held and any(held)
    tokens = [byte_lm.stream(t or "").split() + [b""] for t in texts]
    train = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(train.values()), len(train)
    for r, ws in zip(got, tokens):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    want = plain([t or "" for t, h in zip(texts, held) if not h], [t or "" for t in texts])
    assert [r["score"] for r in got] == pytest.approx(want, rel=1e-6)


def test_chunks_do_not_matter(docs, monkeypatch):
    frame = docs(rows_of(*[PROSE[: 20 * (i + 1)] for i in range(10)]))
    one = {r["doc_id"]: r["score"] for r in byte_lm.score(frame).collect()}
    monkeypatch.setattr(byte_lm, "CHUNK_BYTES", 50)
    monkeypatch.setattr(byte_lm, "BYTES_AT_ONCE", 40)
    monkeypatch.setattr(byte_lm, "GRAMS_AT_ONCE", 10)
    for sent in (byte_lm.SENT_GRAMS, 0):
        monkeypatch.setattr(byte_lm, "SENT_GRAMS", sent)
        many = {r["doc_id"]: r["score"] for r in byte_lm.score(frame.repartition(2)).collect()}
        assert many == pytest.approx(one)


def test_odd_rows(odd, none):
    got = byte_lm.score(odd).collect()
    assert len(got) == odd.count()
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2, 3))
    assert byte_lm.score(none).count() == 0


def test_grams_are_looked_up_in_order(monkeypatch):
    """The values come back in the grams' own order; the search gets them sorted."""
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 5000))
    values, at = np.arange(len(keys)) / 7, np.random.default_rng(3).integers(0, len(keys), 20_000)
    asked, search = [], np.searchsorted
    monkeypatch.setattr(byte_lm.np, "searchsorted", lambda k, x: asked.append(x) or search(k, x))
    assert byte_lm._looked_up(keys, values, keys[at]).tolist() == values[at].tolist()
    assert len(asked) == 1 and (np.diff(asked[0]) >= 0).all()
    assert byte_lm._looked_up(keys, values, keys[:0]).tolist() == []
