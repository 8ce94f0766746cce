"""Small arithmetic rules used by the building and scoring steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def clip_zero(c) -> Column:
    """Lower-clip at 0, NULL stays NULL (``greatest(NULL, 0)`` would give 0)."""
    c = _c(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def safe_ratio(num, den) -> Column:
    """num / den; a zero denominator yields the numerator (the reference turns
    the infinite ratio back into the numerator); NULL denominator stays NULL."""
    num, den = _c(num), _c(den)
    return F.when(den == 0, num.cast("double")).otherwise(F.try_divide(num, den))


def when_set(cond: Column, value, otherwise) -> Column:
    """Conditional overwrite: ``value`` where ``cond`` is true, else ``otherwise``.
    A NULL condition keeps the old value (pandas boolean masks treat NaN as False)."""
    return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(_c(otherwise))


def unit_convert(value, cond: Column, factor: float) -> Column:
    """Multiply ``value`` by ``factor`` on the rows where ``cond`` holds."""
    v = _c(value)
    return when_set(cond, v * F.lit(factor), v)
