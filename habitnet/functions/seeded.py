"""Seeded, partition-independent randomness.

``rand()`` depends on partitioning, so every random choice in the library is
a pure function of the row's key and a seed: ``md5(concat_ws('#', key..., seed))``.
The same text runs in Spark and in DuckDB, which is how the oracle queries
reproduce samples, splits and initial factors exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2^32: the first 8 hex digits of an md5 digest read as an unsigned integer.
_TWO_POW_32 = 4294967296.0


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def md5_key(*parts) -> Column:
    """md5 hex digest of the '#'-joined text of ``parts`` (columns, names or literals)."""
    return F.md5(F.concat_ws("#", *[_as_col(p).cast("string") for p in parts]))


def md5_int32(*parts) -> Column:
    """First 32 bits of the md5 digest as a non-negative bigint in [0, 2^32)."""
    return F.conv(F.substring(md5_key(*parts), 1, 8), 16, 10).cast("bigint")


def md5_uniform(*parts) -> Column:
    """A uniform double in [0, 1) determined by ``parts``."""
    return md5_int32(*parts).cast("double") / F.lit(_TWO_POW_32)
