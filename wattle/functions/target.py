"""Target transforms (log1p on the way in, expm1 on the way out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def log1p_safe(c) -> Column:
    """log(1 + x); NULL where x <= -1 (NumPy would give -inf / NaN)."""
    c = _c(c)
    return F.when(c > -1, F.log1p(c))


def expm1_safe(c) -> Column:
    """exp(x) - 1, the inverse of :func:`log1p_safe`."""
    return F.expm1(_c(c))
