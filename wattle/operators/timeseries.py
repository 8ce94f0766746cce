"""Hourly time-series operators on the (site, hour) weather table.

Scale notes.  Weather holds one row per (site, hour): its size is
sites x hours and does not grow with the readings.  The per-site windows
(interpolation, rolling, leads) therefore sort at most one site's hours per
window partition and spill if needed.  The fills aggregate first
(partial + final) and join the small (site, day, month) mean table back,
so no group is ever buffered whole.  The key-order forward fill runs as a
two-level scan: within a site, then a carry across the (tiny) site table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _hour():
    return F.expr("INTERVAL 1 HOUR")


def site_hour_spine(df: DataFrame, site: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """Every (site, hour) from the global first to the global last hour.

    Sites are the distinct values present (not a fixed 0-15 range).  The
    global bounds reach each site through a window over the per-site bound
    table (one row per site), and the hour sequences are exploded after a
    repartition by site, so spine generation runs in parallel.
    """
    per_site = df.groupBy(site).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    allw = Window.partitionBy()
    bounds = per_site.select(site, F.min("__lo").over(allw).alias("__lo"),
                             F.max("__hi").over(allw).alias("__hi"))
    return (bounds.repartition(site)
            .select(site, F.explode(F.sequence("__lo", "__hi", _hour())).alias(ts)))


def missing_hours(df: DataFrame, site: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """(site, hour) pairs of the spine that the table lacks (set difference)."""
    spine = site_hour_spine(df, site, ts)
    present = df.select(site, ts)
    return spine.join(present, [site, ts], "left_anti")


def gap_fill(df: DataFrame, site: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """Append an all-NULL row for every missing (site, hour): union by name
    of the table and the missing pairs."""
    return df.unionByName(missing_hours(df, site, ts), allowMissingColumns=True)


def _day_month(ts: str):
    return F.dayofmonth(ts).alias("__day"), F.month(ts).alias("__month")


def group_means(df: DataFrame, cols: list[str], site: str = "site_id",
                ts: str = "timestamp") -> DataFrame:
    """Mean of each column per (site, day-of-month, month); the year is not a key."""
    return (df.groupBy(F.col(site), *_day_month(ts))
            .agg(*[F.avg(c).alias(c) for c in cols]))


def impute_group_mean(df: DataFrame, cols: list[str], site: str = "site_id",
                      ts: str = "timestamp") -> DataFrame:
    """Fill NULLs with the mean of the same (site, day, month) group; empty
    groups stay NULL."""
    means = group_means(df, cols, site, ts).select(
        site, "__day", "__month", *[F.col(c).alias(f"__m_{c}") for c in cols])
    keyed = df.select("*", *_day_month(ts))
    j = keyed.join(means, [site, "__day", "__month"], "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def ffill_group_means(means: DataFrame, cols: list[str], site: str = "site_id",
                      across_sites: bool = True) -> DataFrame:
    """Forward-fill empty group means in key order (site, day, month).

    ``across_sites=True`` reproduces the reference: the first groups of a
    site may inherit the last mean of the previous site.  ``False`` keeps
    the fill inside each site.
    """
    w_site = (Window.partitionBy(site).orderBy("__day", "__month")
              .rowsBetween(Window.unboundedPreceding, 0))
    within = means.select(site, "__day", "__month",
                          *[F.last(c, ignorenulls=True).over(w_site).alias(c) for c in cols])
    if not across_sites:
        return within
    order = F.struct("__day", "__month")
    site_last = means.groupBy(site).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])
    w_prev = Window.orderBy(site).rowsBetween(Window.unboundedPreceding, -1)
    carry = site_last.select(site, *[F.last(c, ignorenulls=True).over(w_prev).alias(f"__carry_{c}")
                                     for c in cols])   # one row per site
    j = within.join(carry, site, "left")
    return j.select(site, "__day", "__month",
                    *[F.coalesce(F.col(c), F.col(f"__carry_{c}")).alias(c) for c in cols])


def impute_group_ffill(df: DataFrame, cols: list[str], site: str = "site_id",
                       ts: str = "timestamp", across_sites: bool = True) -> DataFrame:
    """Fill NULLs with the (site, day, month) mean; empty groups take the
    previous group's mean in key order (see :func:`ffill_group_means`)."""
    means = ffill_group_means(group_means(df, cols, site, ts), cols, site, across_sites)
    means = means.select(site, "__day", "__month", *[F.col(c).alias(f"__m_{c}") for c in cols])
    keyed = df.select("*", *_day_month(ts))
    j = keyed.join(means, [site, "__day", "__month"], "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def impute_group_fills(df: DataFrame, mean_cols: list[str], ffill_cols: list[str],
                       site: str = "site_id", ts: str = "timestamp",
                       across_sites: bool = True) -> DataFrame:
    """:func:`impute_group_mean` on ``mean_cols`` and :func:`impute_group_ffill`
    on ``ffill_cols`` with one aggregate and one join back (same keys)."""
    cols = list(mean_cols) + list(ffill_cols)
    means = group_means(df, cols, site, ts)
    if ffill_cols:
        filled = ffill_group_means(means, list(ffill_cols), site, across_sites)
        means = means.select(site, "__day", "__month", *mean_cols).join(
            filled, [site, "__day", "__month"], "inner")
    means = means.select(site, "__day", "__month", *[F.col(c).alias(f"__m_{c}") for c in cols])
    keyed = df.select("*", *_day_month(ts))
    j = keyed.join(means, [site, "__day", "__month"], "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def interpolate_linear(df: DataFrame, cols: list[str], site: str = "site_id",
                       ts: str = "timestamp") -> DataFrame:
    """Linear interpolation by row position within each site (time order);
    leading and trailing NULLs take the nearest value (both directions).

    Previous and next non-NULL values (and their positions) come from two
    running windows, one ascending and one descending in time, so the cost
    is O(n) per site (an unbounded-following frame would be recomputed per row).
    """
    up = Window.partitionBy(site).orderBy(F.col(ts).asc())
    down = Window.partitionBy(site).orderBy(F.col(ts).desc())
    back = up.rowsBetween(Window.unboundedPreceding, 0)
    ahead = down.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("__i", F.row_number().over(up))
    prev = []
    for c in cols:
        v = F.col(c)
        prev += [F.last(v, ignorenulls=True).over(back).alias(f"__pv_{c}"),
                 F.last(F.when(v.isNotNull(), F.col("__i")), ignorenulls=True).over(back).alias(f"__pi_{c}")]
    x = x.select("*", *prev)
    nxt = []
    for c in cols:
        v = F.col(c)
        nxt += [F.last(v, ignorenulls=True).over(ahead).alias(f"__nv_{c}"),
                F.last(F.when(v.isNotNull(), F.col("__i")), ignorenulls=True).over(ahead).alias(f"__ni_{c}")]
    x = x.select("*", *nxt)
    out = []
    for c in cols:
        v, pv, pi, nv, ni = (F.col(c), F.col(f"__pv_{c}"), F.col(f"__pi_{c}"),
                             F.col(f"__nv_{c}"), F.col(f"__ni_{c}"))
        interp = pv + (nv - pv) * (F.col("__i") - pi) / (ni - pi)
        out.append(F.when(v.isNotNull(), v).when(pv.isNull(), nv).when(nv.isNull(), pv)
                   .otherwise(interp).alias(c))
    return x.select(*[F.col(c) for c in df.columns if c not in cols], *out).select(*df.columns)


def corrected_skew(x, n) -> F.Column:
    """Sample (bias-corrected) skewness from Spark's population skewness."""
    return F.when(n >= 3, x * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurt(x, n) -> F.Column:
    """Sample excess kurtosis from Spark's population excess kurtosis."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * x + 6))


ROLLING_STATS = ("mean", "median", "min", "max", "std", "skew")


def rolling_stats(df: DataFrame, cols: list[str], window: int = 18, site: str = "site_id",
                  ts: str = "timestamp", stats=ROLLING_STATS, drop_source: bool = False) -> DataFrame:
    """Trailing ``window``-row statistics per site (current row included,
    NULLs skipped, any count of values accepted: std needs 2, skew 3)."""
    w = Window.partitionBy(site).orderBy(ts).rowsBetween(-(window - 1), 0)
    new = []
    for c in cols:
        v = F.col(c)
        n = F.count(v).over(w)
        fns = {
            "mean": F.avg(v).over(w),
            "median": F.percentile(v, 0.5).over(w),
            "min": F.min(v).over(w),
            "max": F.max(v).over(w),
            "std": F.stddev_samp(v).over(w),
            "skew": corrected_skew(F.skewness(v).over(w), n),
        }
        new += [fns[s].alias(f"{c}_{s}_lag{window}") for s in stats]
    keep = [F.col(c) for c in df.columns if not (drop_source and c in cols)]
    return df.select(*keep, *new)


def lead_features(df: DataFrame, col: str, steps=(1, 2, 3), site: str = "site_id",
                  ts: str = "timestamp") -> DataFrame:
    """Value 1..k hours ahead within the same site (``<col>_lead<k>``)."""
    w = Window.partitionBy(site).orderBy(ts)
    return df.select("*", *[F.lead(col, k).over(w).alias(f"{col}_lead{k}") for k in steps])
