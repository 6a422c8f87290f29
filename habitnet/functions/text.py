"""String, number and day expressions (F14..F16, P4)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_fields(line: Column | str, sep: str = "|") -> Column:
    """split a delimited line on a literal separator (escaped for the regex)."""
    col = F.col(line) if isinstance(line, str) else line
    return F.split(col, re.escape(sep), -1)


def field(parts: Column, idx: int) -> Column:
    """0-based positional pick; null when the line is too short."""
    return F.try_element_at(parts, F.lit(idx + 1))


def to_int(x: Column) -> Column:
    """text -> number; bad numbers become null instead of failing the task."""
    return F.trim(x).try_cast("bigint")


def epoch_to_day(sec: Column) -> Column:
    """Epoch seconds -> calendar day in the session time zone."""
    return F.to_date(F.timestamp_seconds(sec))


def epoch_to_day_text(sec: Column) -> Column:
    """F16: epoch seconds -> 'yyyyMMdd' text."""
    return F.date_format(F.timestamp_seconds(sec), "yyyyMMdd")


def day_text_to_date(txt: Column) -> Column:
    """'yyyyMMdd' text -> date (null when malformed)."""
    return F.try_to_timestamp(txt, F.lit("yyyyMMdd")).cast("date")
