import random
import zlib

import numpy as np
import pytest
from habitnet.llm import quality_model, toxicity
from habitnet.llm.labelled import fold

RNG = random.Random(5)
SYLLABLES = ["ta", "re", "mi", "so", "lu", "ke", "no", "va"]


def prose(n):
    words = ["".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 12]) for i in range(0, n, 12)) + "."


def documents(kind):
    rows, labels = [], []
    for i in range(480):
        text, bad = prose(60), i % 3 == 0
        if bad and kind == "quality":
            text = " | ".join(text.split())
        if bad and kind == "toxic":
            words = text.split(" ")
            for _ in range(3):
                words.insert(RNG.randrange(len(words)), "grumf" + RNG.choice(["a", "el", "or"]))
            text = " ".join(words)
        rows.append((i, text, "en", "s", 0, 0, ""))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


@pytest.mark.parametrize("module, kind", [(quality_model, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, docs, module, kind):
    rows, labels = documents(kind)
    got = module.classify(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {i: q if kind == "quality" else t for i, q, t in labels}
    held = [r for r in got.collect() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_held_out_labels_and_metadata_are_not_read(spark, docs, module):
    rows, labels = documents("quality" if module is quality_model else "toxic")
    held = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    schema = "doc_id long, quality int, toxic int"
    plain = module.classify(docs(rows), spark.createDataFrame(labels, schema))
    turned = [(i, 1 - q, 1 - t) if i in held else (i, q, t) for i, q, t in labels]
    other = module.classify(docs([(r[0], r[1], "xx", "zz", 9, 9, "q") for r in rows]), spark.createDataFrame(turned, schema))
    assert [r["score"] for r in plain.orderBy("doc_id").collect()] == pytest.approx([r["score"] for r in other.orderBy("doc_id").collect()], abs=1e-9)


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_odd_rows(spark, odd, none, module):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = module.classify(odd, some).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert module.classify(none, labels).count() == 0


def test_folds(spark):
    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", fold("doc_id" and __import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id")).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in got.collect())


def test_contexts_do_not_depend_on_partitions(docs):
    rows, _ = documents("quality")
    one, many = (quality_model.word_vectors(docs(rows).repartition(n)) for n in (1, 5))
    assert np.array_equal(one, many)


def test_spelling_models_are_probabilities(spark, docs):
    import pandas as pd

    counts = pd.DataFrame([(c, w, n) for c in (0, 1) for w, n in (("ab", 3 - c), ("abc", 1), ("ba", 1 + c), ("c", 2))], columns=["label", "word", "n"])
    tables = toxicity.model(counts)
    letters = sorted({chr(97 + i) for i in range(3)})
    for context in ("", "a", "ab", "zz"):
        total = np.zeros(2)
        for last in range(1 << toxicity.LETTER_BITS):
            spelt = np.array([toxicity.BEGIN] * toxicity.ORDER + [ord(c) % 1021 + toxicity.FIRST_LETTER for c in context] + [last])
            p = np.full((2, 1), 2.0**-toxicity.LETTER_BITS)
            for order, t in enumerate(tables):
                gram = toxicity.grams(spelt, np.array([len(spelt) - 1]), order)
                at, hit = toxicity._found(t["keys"], gram)
                ctx, known = toxicity._found(t["contexts"], gram >> toxicity.LETTER_BITS)
                p = np.where(hit, t["seen"][:, at], 0) + np.where(known, t["backoff"][:, ctx], 1) * p
            total += p[:, 0]
        assert total == pytest.approx([1, 1], abs=1e-9), (letters, context)
