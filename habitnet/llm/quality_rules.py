"""Line-first quality rules.

Every line is judged by itself: a line of symbols, of separators, of shouted
words, of stuttered words or of boilerplate is removed. A document is rejected
if the removed lines held more than ``MAX_LOST_PERCENT`` of its words, or if
the whole text fails the base rules (too few words, too much repetition).

Defined cases: a null text counts as the empty text (no words, rejected); lines
without words are neither judged nor counted; repeated rows are judged alike,
one result for each. An empty table gives no rows; texts are read whole,
however long, one at a time; percentages that a limit equals pass, so there
are no ties. Other columns keep their values whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitnet.llm.common import LOWER_ASCII, fresh_name, struct_of, words

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Share of a document's words that may go with its removed lines.
MAX_LOST_PERCENT = 50
#: Symbols, separators and shouts per hundred words of a line.
MAX_SYMBOL_PERCENT = 30
MAX_SEPARATOR_PERCENT = 20
MAX_SHOUT_PERCENT = 30
#: Words per hundred that equal the word before them, in a line of 10 words or more.
MAX_STUTTER_PERCENT = 50
STUTTER_FROM_WORDS = 10
#: A menu is a line of few words with at least two entries of this list.
MENU_MAX_WORDS = 12
MENU_MIN_ENTRIES = 2

SYMBOLS = "#*$%&|<>"
SEPARATOR_PATTERN = "[|»›•·]"
SHOUT_PATTERN = "[!?][!?]+"
MENU_PATTERN = "home|login|log in|sign in|sign up|register|search|menu|contact us|about us|sitemap|next page|previous page"
BOILERPLATE_PATTERN = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|"
    "enable javascript|click here to|lorem ipsum|subscribe to our|skip to (main )?content"
)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_bad_lines long, n_lost_words long, clean_text string"
)


def repeated_window_words(tokens: list, window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words that occur twice or more.

    Windows are named by ranking pairs of half windows, so equal names mean
    equal windows; the ranks double their reach each time (``window`` is a
    power of two).
    """
    n = len(tokens)
    if n <= window:
        return 0
    seen: dict = {}
    rank = np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int64, n)
    reach, kinds = 1, len(seen)
    while reach < window:
        pair = rank[:-reach] * kinds + rank[reach:]
        names, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        kinds = len(names)
        if kinds == len(pair):
            return 0
        reach *= 2
    starts = np.flatnonzero(count[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:n]) > 0))


_SEPARATOR = re.compile(SEPARATOR_PATTERN)
_SHOUT = re.compile(SHOUT_PATTERN)
_MENU = re.compile(MENU_PATTERN)
_BOILERPLATE = re.compile(BOILERPLATE_PATTERN)
_SYMBOL = re.compile("[#*$%&|<>]")


def line_fails(line: str, tokens: list) -> bool:
    """Whether a line with words ``tokens`` breaks one of the line rules."""
    n = len(tokens)
    if 100 * len(_SYMBOL.findall(line)) > MAX_SYMBOL_PERCENT * n:
        return True
    if 100 * len(_SEPARATOR.findall(line)) > MAX_SEPARATOR_PERCENT * n:
        return True
    if 100 * len(_SHOUT.findall(line)) > MAX_SHOUT_PERCENT * n:
        return True
    if n >= STUTTER_FROM_WORDS and 100 * sum(a == b for a, b in zip(tokens, tokens[1:])) > MAX_STUTTER_PERCENT * n:
        return True
    low = line.translate(LOWER_ASCII)
    if _BOILERPLATE.search(low):
        return True
    return n <= MENU_MAX_WORDS and len(_MENU.findall(low)) >= MENU_MIN_ENTRIES


def judge(text: str) -> tuple:
    """One document's row of ``SCHEMA``."""
    tokens = words(text)
    n_words = len(tokens)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    earlier: set = set()
    n_dup = n_lines = n_bad = lost = 0
    clean = []
    for line in text.split("\n"):
        own = words(line)
        if not own:
            clean.append(line)
            continue
        n_lines += 1
        if line in earlier:
            n_dup += 1
        earlier.add(line)
        if line_fails(line, own):
            n_bad += 1
            lost += len(own)
        else:
            clean.append(line)
    n_repeat = repeated_window_words(tokens)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * n_words
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, n_lines, n_bad, lost, "\n".join(clean)


def _judge_series(texts: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pd.DataFrame([judge(t if isinstance(t, str) else "") for t in texts.tolist()], columns=names)


def rules(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct column of ``SCHEMA``; returns it under the name ``judged_name(df)``."""
    judged = F.pandas_udf(_judge_series, struct_of(SCHEMA)).asNondeterministic()
    return df.withColumn(judged_name(df), judged(F.col(f"`{text}`")))


def judged_name(df: DataFrame) -> str:
    return fresh_name(df, "_judged")


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, their failing lines removed; same columns."""
    name = judged_name(df)
    return (
        rules(df, text)
        .where(F.col(f"{name}.kept"))
        .select(*[F.col(f"{name}.clean_text").alias(text) if c == text else F.col(f"`{c}`") for c in df.columns])
    )


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measures and verdicts per document, without its text."""
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    name = judged_name(own)
    return rules(own).select("doc_id", *[F.col(f"{name}.{f.name}").alias(f.name) for f in struct_of(SCHEMA) if f.name != "clean_text"])
