"""Dense-vector and scoring expressions as Spark columns.

Vectors live either as ``array<double>`` columns (API edge, storage) or as a
list of scalar columns ``f0..f{d-1}`` (inside training loops, so that one
``groupBy`` with ``d`` sums stays in whole-stage codegen). Every function here
returns a ``Column``; nothing runs in Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = Column | str


def _c(x: ColLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- array<double> form ------------------------------------------------------------

def dot(a: ColLike, b: ColLike) -> Column:
    """sum_i a_i * b_i."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: ColLike) -> Column:
    """Euclidean norm sqrt(sum x^2) (the true L2 norm, see README Q1)."""
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def unit_vector(a: ColLike) -> Column:
    """|x_i| / |a| for every coordinate (absolute values, as in the source model)."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.abs(x) / n)


def add(a: ColLike, b: ColLike) -> Column:
    """element-wise a + b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a: ColLike, b: ColLike) -> Column:
    """element-wise a - b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a: ColLike, w: ColLike | float) -> Column:
    """w * a."""
    wc = w if isinstance(w, Column) else (F.col(w) if isinstance(w, str) else F.lit(float(w)))
    return F.transform(_c(a), lambda x: x * wc)


def weighted_add(a: ColLike, b: ColLike, w1: float = 1.0, w2: float = 1.0) -> Column:
    """F8: w1 * a + w2 * b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.lit(float(w1)) * x + F.lit(float(w2)) * y)


def element(a: ColLike, idx: int) -> Column:
    """0-based element access."""
    return F.element_at(_c(a), idx + 1)


# ---- scalar-column form (f0..f{d-1}) ---------------------------------------------------


def dot_cols(a: Sequence[ColLike], b: Sequence[ColLike]) -> Column:
    """Sum of products over two equally long lists of scalar columns."""
    terms = [_c(x) * _c(y) for x, y in zip(a, b, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def norm_cols(a: Sequence[ColLike]) -> Column:
    return F.sqrt(dot_cols(a, a))


# ---- scores and losses -----------------------------------------------------------------


def sigmoid(x: ColLike) -> Column:
    """1 / (1 + e^-x)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def log_loss(r: ColLike, p: ColLike) -> Column:
    """-r ln s(p) - (1-r) ln(1 - s(p)), in the overflow-free form
    log(1 + e^-|p|) + max(p, 0) - r p."""
    pc = _c(p)
    return F.log1p(F.exp(-F.abs(pc))) + F.greatest(pc, F.lit(0.0)) - _c(r) * pc


def sign(x: ColLike) -> Column:
    """-1, 0 or 1 (0 maps to 0)."""
    return F.signum(_c(x))
