"""Row filters, conditional overwrites and simple casts.

Every predicate is a plain Column expression so Catalyst pushes it into the
Parquet scan where the columns allow (`PushedFilters`).  pandas keeps a row
when a boolean mask is NaN-False; the ``coalesce(.., False)`` guards below
keep that behaviour where SQL's three-valued logic would drop the row.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.arith import when_set


def segment_filter(df: DataFrame, col: str, value) -> DataFrame:
    """Rows of one segment (meter or site)."""
    return df.filter(F.col(col) == F.lit(value))


def in_not_in(df: DataFrame, col: str, values, not_col: str, not_values) -> DataFrame:
    """``col IN values AND NOT (not_col IN not_values)``."""
    return df.filter(F.col(col).isin(*values) & ~F.col(not_col).isin(*not_values))


def exclude_entity(df: DataFrame, col: str, value) -> DataFrame:
    """Drop one entity; rows with a NULL key are kept (pandas ``!=``)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def drop_where(df: DataFrame, cond) -> DataFrame:
    """Drop rows where ``cond`` is true; a NULL condition keeps the row."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def drop_startup_outliers(df: DataFrame, max_building: int, meter_value, before,
                          building: str = "building_id", meter: str = "meter",
                          ts: str = "timestamp", site: str | None = None, site_value=None,
                          inclusive: bool = False) -> DataFrame:
    """Drop the start-up stretch of one meter of the low-numbered buildings.

    ``before`` is an explicit timestamp bound (string ``yyyy-MM-dd[ HH:mm:ss]``
    or datetime); ``inclusive`` selects ``<=`` over ``<``.  (The reference's
    text compare ``<= "2016-05-20"`` equals ``< 2016-05-20 00:00:00`` +
    nothing of that day; ``< "2016-05-21"`` keeps all of 05-20 in the drop.)
    """
    bound = F.lit(before).cast("timestamp_ntz") if isinstance(before, (str, _dt.datetime)) else before
    t = F.col(ts)
    cond = (F.col(building) <= max_building) & (F.col(meter) == F.lit(meter_value))
    cond = cond & ((t <= bound) if inclusive else (t < bound))
    if site is not None:
        cond = cond & (F.col(site) == F.lit(site_value))
    return drop_where(df, cond)


def drop_bad_rows(df: DataFrame, bad: DataFrame, row_id: str = "row_id", pos: str = "pos") -> DataFrame:
    """Remove rows whose position is listed in ``bad`` (anti join, no collect;
    duplicates in the list are harmless, so no distinct shuffle)."""
    b = bad.select(F.col(pos).alias("__bad_pos"))
    return df.join(b, F.col(row_id) == F.col("__bad_pos"), "left_anti")


def position_bitmap(bad: DataFrame, pos: str = "pos") -> DataFrame:
    """The listed positions as a bitmap: (word, bits), one row per run of 64 positions that
    holds any, with a bit for each.  Dense stretches of a list shrink 64-fold, and no row
    is added where positions lie alone; repeated and null positions do no harm."""
    p = F.col(pos).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))
    return bad.filter(p.isNotNull()).groupBy(F.shiftright(p, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def drop_by_bitmap(df: DataFrame, bitmap: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Remove the rows whose position has its bit set in ``bitmap`` (see
    :func:`position_bitmap`): a join on the word, then a test of the bit.  No hint: the
    planner sizes the bitmap, which is aggregated before it is shuffled or broadcast."""
    b = bitmap.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    p = F.col(row_id).cast("long")
    j = df.join(b, F.shiftright(p, 6) == F.col("__word"), "left")
    hit = F.getbit(F.col("__bits"), p.bitwiseAND(63).cast("int")) == 1
    return j.filter(~F.coalesce(hit, F.lit(False))).select(*df.columns)


def clip_negative(df: DataFrame, col: str, to: float = 0.0) -> DataFrame:
    """Overwrite negative values with ``to`` (NULL stays NULL)."""
    c = F.col(col)
    return df.withColumn(col, when_set(c < 0, F.lit(to), c))


def fill_const(df: DataFrame, value=0, subset: list[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=subset)


def year_range(df: DataFrame, ts: str, first_year: int, last_year: int) -> DataFrame:
    """Rows with first_year <= year(ts) <= last_year, as a timestamp range so
    Parquet min/max statistics can skip row groups."""
    lo = F.lit(f"{first_year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{last_year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    t = F.col(ts)
    if dict(df.dtypes).get(ts) == "timestamp":
        lo, hi = lo.cast("timestamp"), hi.cast("timestamp")
    return df.filter((t >= lo) & (t < hi))


def cast_flags(df: DataFrame, cols: list[str], to: str = "int") -> DataFrame:
    """Boolean (or other) columns cast; out-of-range values become NULL."""
    return df.select(*[F.col(c).try_cast(to).alias(c) if c in cols else F.col(c) for c in df.columns])
