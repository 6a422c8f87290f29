"""Toxicity by class-conditional Kneser-Ney models.

Two models spell words letter by letter, one learnt from toxic documents and
one from ordinary ones: the probability of a letter after the ``ORDER`` before
it (words are padded at their begin and closed by an end mark), with absolute
discounting and interpolation down the orders. The highest order counts in how
many documents a word was seen, lower orders in how many different contexts.
The two lowest orders are shared by the classes, so expressions that neither
has seen much of are spelt alike by both and say little.

A word's evidence is its toxic minus its ordinary log-likelihood. A text's is
the mean per word, that of its most toxic sentence per word (with
``SENTENCE_PRIOR`` words of no evidence added, as short sentences vary more),
and that of its most toxic word. A logistic function, fitted on a part of the
sample that the models haven't seen, turns these into a score.

Counts come from Spark; the models are as large as a bounded sample of labelled
rows makes them and are broadcast.

Defined cases: null and empty texts have no evidence; without labelled rows of
both classes every score is the share of label 1 among them (0.5 if there are
none); repeated rows score alike. An empty table gives no rows; texts
are read whole, a sentence at a time; a score equal to the threshold counts as toxic. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitnet.llm.common import map_batches, worker_memo
from habitnet.llm.labelled import HELD_OUT_FOLD, fold, sample

#: The most labelled documents of each class that the models learn from.
ROWS_PER_CLASS = 4_000
ORDER = 4
SHARED_ORDERS = 2
DISCOUNT = 0.75
SENTENCE_PRIOR = 4
THRESHOLD = 0.3
#: Words whose evidence a worker remembers, and words spelt at a time.
REMEMBERED = 300_000
WORDS_AT_ONCE = 20_000
#: Letters are numbers below 1,024: the marks, then the code point modulo 1,021.
LETTER_BITS = 10
BEGIN, END, FIRST_LETTER = 1, 2, 3
_TOKEN = re.compile(r"\w+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def sentences(text: str) -> list[list[str]]:
    """The lower-case words of each sentence that has any."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall(text.lower()):
        if token in _ENDS:
            if out[-1]:
                out.append([])
        else:
            out[-1].append(token)
    return out if out[-1] else out[:-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        counts: Counter = Counter()
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            counts.update((label, w) for w in {w for s in sentences(text or "") for w in s})
        if counts:
            labels, words = zip(*counts)
            yield {"label": labels, "word": words, "n": list(counts.values())}


def word_counts(rows: DataFrame) -> DataFrame:
    """``(label, word, n)``: in how many documents of a class a word is."""
    counted = map_batches(rows.select("label", "text"), _count, "label int, word string, n long")
    return counted.groupBy("label", "word").agg(F.sum("n").alias("n"))


def spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words with their marks; where letters to be predicted are; whose they are."""
    begin = chr(BEGIN) * ORDER
    text = begin + (chr(END) + begin).join(words) + chr(END)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letters = np.where(raw < FIRST_LETTER, raw, raw % 1021 + FIRST_LETTER)
    places = np.flatnonzero(letters != BEGIN)
    closes = letters[places] == END
    return letters, places, np.cumsum(closes) - closes


def grams(letters: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """Each letter with the ``order`` before it as one number, the letter in its lowest bits."""
    out = np.zeros(len(places), np.int64)
    for back in range(order + 1):
        out |= letters[places - back] << (LETTER_BITS * back)
    return out


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, counts, len(unique)).astype(float)


def _class_counts(words: list[str], documents: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: grams and counts (documents at the highest order, different contexts below)."""
    letters, places, whose = spelt(words)
    tables = [_summed(grams(letters, places, ORDER), documents[whose])]
    for order in range(ORDER - 1, -1, -1):
        tables.append(_summed(tables[-1][0] & ((1 << LETTER_BITS * (order + 1)) - 1)))
    return tables[::-1]


def model(counts: pd.DataFrame) -> list[dict]:
    """Per order: the discounted probabilities of grams and the backoff weights of contexts, by class."""
    by_class = [_class_counts(own["word"].tolist(), own["n"].to_numpy(float)) for own in (counts[counts["label"] == c] for c in (0, 1))]
    out = []
    for order in range(ORDER + 1):
        both = [by_class[c][order] for c in (0, 1)]
        if order < SHARED_ORDERS:
            both = [_summed(np.concatenate([both[0][0], both[1][0]]), np.concatenate([both[0][1], both[1][1]]))] * 2
        keys = np.unique(np.concatenate([both[0][0], both[1][0]]))
        contexts = np.unique(keys >> LETTER_BITS)
        seen, backoff = np.zeros((2, len(keys))), np.ones((2, len(contexts)))
        for c, (gram, n) in enumerate(both):
            context = np.searchsorted(contexts, gram >> LETTER_BITS)
            total, kinds = np.bincount(context, n, len(contexts)), np.bincount(context, minlength=len(contexts))
            seen[c, np.searchsorted(keys, gram)] = (n - DISCOUNT) / total[context]
            backoff[c] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
        out.append({"keys": keys, "seen": seen, "contexts": contexts, "backoff": backoff})
    return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_evidence(tables: list[dict], words: list[str]) -> np.ndarray:
    letters, places, whose = spelt(words)
    p = np.full((2, len(places)), 2.0**-LETTER_BITS)
    for order, t in enumerate(tables):
        gram = grams(letters, places, order)
        at, hit = _found(t["keys"], gram)
        context, known = _found(t["contexts"], gram >> LETTER_BITS)
        p = np.where(hit, t["seen"][:, at], 0) + np.where(known, t["backoff"][:, context], 1) * p
    return np.bincount(whose, np.log(p[1]) - np.log(p[0]), len(words))


def evidence(tables: list[dict], texts: list[str]) -> np.ndarray:
    """Per text: the mean of its words' evidence, that of its most toxic sentence, and its most toxic word's."""
    memo = worker_memo()
    if memo.get("toxicity-tables") is not tables or len(memo["toxicity-words"]) > REMEMBERED:
        memo["toxicity-tables"], memo["toxicity-words"] = tables, {}
    known = memo["toxicity-words"]
    split = [sentences(t) for t in texts]
    new = list({w for s in split for words in s for w in words if w not in known})
    for at in range(0, len(new), WORDS_AT_ONCE):
        part = new[at : at + WORDS_AT_ONCE]
        known.update(zip(part, word_evidence(tables, part).tolist()))
    out = np.zeros((len(texts), 3))
    for i, parts in enumerate(split):
        if parts:
            own = [[known[w] for w in words] for words in parts]
            out[i] = (
                sum(map(sum, own)) / sum(map(len, own)),
                max(sum(x) / (len(x) + SENTENCE_PRIOR) for x in own),
                max(map(max, own)),
            )
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the constant) of a ridged logistic regression, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1e-3] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence_udf(shared):
    def run(texts: pd.Series) -> pd.Series:
        whole = [t if isinstance(t, str) else "" for t in texts.tolist()]
        parts = [evidence(shared.value, whole[at : at + 256]) for at in range(0, len(whole), 256)]
        return pd.Series([x for part in parts for x in part.tolist()], dtype=object)

    return F.pandas_udf(run, "array<double>").asNondeterministic()


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    context = docs.sparkSession.sparkContext
    rows = sample(docs, labels, label, rows_per_class)
    counts = word_counts(rows.where(~F.col("part"))).toPandas()  # as large as the sample at most
    known = F.col("doc_id").cast("long").alias("doc_id")
    if counts["label"].nunique() < 2:
        share = rows.agg(F.avg("label")).first()[0]
        scored = docs.select(known, F.lit(0.5 if share is None else float(share)).alias("score"))
    else:
        shared = context.broadcast(model(counts))
        seen = rows.where("part").select("label", _evidence_udf(shared)("text").alias("x")).toPandas()
        y = seen["label"].to_numpy(float)
        w = [0.0, 0.0, 1.0, 0.0]
        if len(set(y)) == 2:
            w = logistic(np.array(seen["x"].tolist()), y).tolist()
        x = F.col("x")
        z = F.lit(w[3]) + F.lit(w[0]) * x[0] + F.lit(w[1]) * x[1] + F.lit(w[2]) * x[2]
        found = docs.select(known, _evidence_udf(shared)("text").alias("x"))
        scored = found.select("doc_id", (1 / (1 + F.exp(F.least(F.greatest(-z, F.lit(-500.0)), F.lit(500.0))))).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
