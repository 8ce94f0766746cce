"""Calendar features on timestamp columns (timezone-free: timestamp_ntz in, ints out)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The US holiday dates the reference flags, 2016-01-01 .. 2019-01-01.
REFERENCE_HOLIDAYS = (
    "2016-01-01", "2016-01-18", "2016-02-15", "2016-05-30", "2016-07-04",
    "2016-09-05", "2016-10-10", "2016-11-11", "2016-11-24", "2016-12-26",
    "2017-01-02", "2017-01-16", "2017-02-20", "2017-05-29", "2017-07-04",
    "2017-09-04", "2017-10-09", "2017-11-10", "2017-11-23", "2017-12-25",
    "2018-01-01", "2018-01-15", "2018-02-19", "2018-05-28", "2018-07-04",
    "2018-09-03", "2018-10-08", "2018-11-12", "2018-11-22", "2018-12-25",
    "2019-01-01",
)

# Month -> bucket maps.  Seasons: (12,1,2)->1, (3,4,5)->2, (6,7,8)->3, (9,10,11)->4.
SEASONS = {1: (12, 1, 2), 2: (3, 4, 5), 3: (6, 7, 8), 4: (9, 10, 11)}
# Thirds of the year: (1,2,3,4)->1, (5,6,7,8)->2, (9,10,11,12)->3.
THIRDS = {1: (1, 2, 3, 4), 2: (5, 6, 7, 8), 3: (9, 10, 11, 12)}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def fixed_date_holidays(years, month_days=((1, 1), (7, 4), (11, 11), (12, 25))) -> list[str]:
    """Rule-built calendar: the given fixed (month, day) holidays for each year."""
    return [_dt.date(y, m, d).isoformat() for y in years for (m, d) in month_days]


def month_bucket(month, mapping: dict[int, tuple[int, ...]]) -> Column:
    """Recode month numbers into buckets; unmapped values pass through."""
    m = _c(month)
    expr = None
    for bucket, months in mapping.items():
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(bucket)) if expr is None else expr.when(cond, F.lit(bucket))
    return expr.otherwise(m)


def season(ts) -> Column:
    return month_bucket(F.month(_c(ts)), SEASONS)


def third_of_year(ts) -> Column:
    return month_bucket(F.month(_c(ts)), THIRDS)


def weekday_monday0(ts) -> Column:
    """Day of week with Monday = 0 .. Sunday = 6 (not ``dayofweek``: Sunday = 1)."""
    return F.weekday(_c(ts))


def weekday_collapse(weekday, days=(1, 2, 3), to: int = 1) -> Column:
    """Map Tuesday..Thursday (1, 2, 3) onto one value."""
    w = _c(weekday)
    return F.when(w.isin(*days), F.lit(to)).otherwise(w)


def weekend_flag(ts) -> Column:
    return (F.weekday(_c(ts)) >= 5).cast("int")


def holiday_flag(ts, dates=REFERENCE_HOLIDAYS, midnight_only: bool = False) -> Column:
    """1 when the timestamp's date is in ``dates``.

    ``midnight_only`` reproduces the reference variant that compared full
    timestamps with dates, which only matches 00:00:00.  The list is a small
    fixed calendar, so an IN-list literal (no join) is used.
    """
    t = _c(ts)
    hit = F.to_date(t).isin(*[F.lit(d).cast("date") for d in dates])
    if midnight_only:
        hit = hit & (F.hour(t) == 0) & (F.minute(t) == 0) & (F.second(t) == 0)
    return F.coalesce(hit, F.lit(False)).cast("int")


def calendar_columns(df: DataFrame, ts: str = "timestamp", prefix: str = "") -> DataFrame:
    """month, hour, day, week-of-year, year, weekday (Mon=0), day-of-year."""
    t = F.col(ts)
    return df.select(
        "*",
        F.month(t).alias(f"{prefix}month"),
        F.hour(t).alias(f"{prefix}hour"),
        F.dayofmonth(t).alias(f"{prefix}day"),
        F.weekofyear(t).alias(f"{prefix}week"),
        F.year(t).alias(f"{prefix}year"),
        F.weekday(t).alias(f"{prefix}day_of_week"),
        F.dayofyear(t).alias(f"{prefix}year_day"),
    )
