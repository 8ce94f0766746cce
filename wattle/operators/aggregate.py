"""Grouped statistics and per-group profiles.

All statistics are algebraic or mergeable Spark aggregates, so Spark
computes partial aggregates before the shuffle.  Exact median/quantiles keep
a value->count map per group (exact, as pandas); pass ``exact=False`` to
switch to the bounded-memory ``percentile_approx`` sketch when a group can
hold billions of distinct values.  The mean absolute deviation needs the
group mean first, so it is a second aggregate over rows joined to the table of
means (planner-sized) — never a window that buffers a group.  ``quantiles``
ranks the distinct (group, value) pairs over range partitions instead, so that
a few huge groups are no burden on single tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.operators.timeseries import corrected_kurt, corrected_skew
from wattle.session import write_table

PROFILE_STATS = ("max", "mean", "std", "skew", "median", "q80", "q30", "kurt", "mad", "ptp")


def _pct(c: Column, p: float, exact: bool, accuracy: int = 10000) -> Column:
    return F.percentile(c, p) if exact else F.percentile_approx(c, p, accuracy).cast("double")


def _pcts(c: Column, probs, exact: bool, accuracy: int = 10000) -> Column:
    """All requested quantiles from one aggregate buffer (one value->count map
    or one sketch per group, not one per quantile)."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return F.percentile(c, arr) if exact else F.percentile_approx(c, arr, accuracy)


def group_mean(df: DataFrame, keys: list[str], col: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(col).alias(name or f"{col}_mean"))


def profile_mean_median(df: DataFrame, keys: list[str], col: str, suffix: str,
                        exact: bool = True) -> DataFrame:
    """``mean_<suffix>``, ``median_<suffix>`` per key."""
    c = F.col(col)
    return df.groupBy(*keys).agg(F.avg(c).alias(f"mean_{suffix}"),
                                 _pct(c, 0.5, exact).alias(f"median_{suffix}"))


def profile_max_mean_std(df: DataFrame, keys: list[str], col: str, prefix: str | None = None) -> DataFrame:
    p = prefix or col
    c = F.col(col)
    return df.groupBy(*keys).agg(F.max(c).alias(f"{p}_max"), F.avg(c).alias(f"{p}_mean"),
                                 F.stddev_samp(c).alias(f"{p}_std"))


def profile_full(df: DataFrame, keys: list[str], col: str, prefix: str | None = None,
                 exact: bool = True, stats=PROFILE_STATS) -> DataFrame:
    """The ten-statistic profile (max, mean, std, skew, median, q80, q30,
    kurt, mad, ptp), pandas definitions: sample std, bias-corrected skew and
    excess kurtosis, linear quantiles, *mean* absolute deviation."""
    p = prefix or col
    c = F.col(col)
    n = F.count(c)
    qs = {"median": 0.5, "q80": 0.8, "q30": 0.3}
    wanted = [s for s in stats if s in qs]
    exprs = {
        "max": F.max(c), "mean": F.avg(c), "std": F.stddev_samp(c),
        "skew": corrected_skew(F.skewness(c), n),
        "kurt": corrected_kurt(F.kurtosis(c), n), "ptp": F.max(c) - F.min(c),
    }
    aggs = [exprs[s].alias(f"{p}_{s}") for s in stats if s in exprs]
    if wanted:
        aggs.append(_pcts(c, [qs[s] for s in wanted], exact).alias("__q"))
    first = df.groupBy(*keys).agg(*aggs)
    if wanted:
        first = first.select(*[F.col(x) for x in first.columns if x != "__q"],
                             *[F.col("__q")[i].cast("double").alias(f"{p}_{s}") for i, s in enumerate(wanted)])
    if "mad" not in stats:
        return first
    first = write_table(first, "profile")       # both the deviations and the result read it
    if "mean" in stats:
        mad = mean_abs_dev(df, keys, col, f"{p}_mad", first.select(*keys, F.col(f"{p}_mean").alias("__mu")))
    else:
        mad = mean_abs_dev(df, keys, col, f"{p}_mad")
    out = first.join(mad, keys, "inner")
    return out.select(*keys, *[f"{p}_{s}" for s in stats])


def profile_fold_safe(df: DataFrame, keys: list[str], col: str, fold: str, k: int,
                      stats=("mean", "median", "std"), prefix: str | None = None,
                      exact: bool = True) -> DataFrame:
    """Per-group statistics computed, for each fold f, from the rows of the
    other folds only (no leak of the held-out rows into their own features).

    Each row is replicated into the k-1 training sets it belongs to (k is the
    small fold count, so the data grows by a bounded factor, never by pairs of
    rows), then aggregated by (keys, target fold): medians and quantiles are
    not subtractable, so this is the exact form.  Returns keys, fold and the
    statistics, to be joined back on (keys, fold).
    """
    p = prefix or col
    folds_arr = F.array(*[F.lit(i) for i in range(k)])
    others = F.filter(folds_arr, lambda x: x != F.col(fold))
    rep = df.select(*keys, col, F.explode(others).alias(fold))
    c = F.col(col)
    n = F.count(c)
    qs = {"median": 0.5, "q80": 0.8, "q30": 0.3}
    wanted = [s for s in stats if s in qs]
    exprs = {"mean": F.avg(c), "std": F.stddev_samp(c), "max": F.max(c), "min": F.min(c), "count": n,
             "skew": corrected_skew(F.skewness(c), n), "kurt": corrected_kurt(F.kurtosis(c), n),
             "ptp": F.max(c) - F.min(c)}
    aggs = [exprs[s].alias(f"{p}_{s}") for s in stats if s in exprs]
    if wanted:
        aggs.append(_pcts(c, [qs[s] for s in wanted], exact).alias("__q"))
    out = rep.groupBy(*keys, fold).agg(*aggs)
    cols = [F.col(f"{p}_{s}") if s in exprs else
            F.col("__q")[wanted.index(s)].cast("double").alias(f"{p}_{s}") for s in stats]
    return out.select(*keys, fold, *cols)


def mean_abs_dev(df: DataFrame, keys: list[str], col: str, name: str = "mad", means: DataFrame | None = None) -> DataFrame:
    """Mean absolute deviation from the group mean (two aggregates); ``means`` are
    the groups' means as ``__mu`` where they are known already."""
    means = df.groupBy(*keys).agg(F.avg(col).alias("__mu")) if means is None else means
    j = df.select(*keys, col).join(means, keys, "inner")
    # NULL keys drop out in the equi join, as pandas' groupby drops NaN keys
    return j.groupBy(*keys).agg(F.avg(F.abs(F.col(col) - F.col("__mu"))).alias(name))


def quantiles(df: DataFrame, keys: list[str], col: str, probs=(0.3, 0.8), exact: bool = True) -> DataFrame:
    """Linear-interpolated quantiles per group.

    Exact: the distinct (group, value) pairs are counted and ranked over range
    partitions, so the running count of a value in its group comes from the counts
    of whole partitions and of the values before it in its own; each quantile then
    takes the two values around its place.  No task holds a group.  ``exact=False``:
    one sketch per group."""
    names = [f"q{int(round(q * 100))}" for q in probs]
    if not exact:
        g = df.groupBy(*keys).agg(_pcts(F.col(col), probs, False).alias("__q"))
        return g.select(*keys, *[F.col("__q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    pairs = df.groupBy(*keys, F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = write_table(pairs.repartitionByRange(n, *keys, "__v").withColumn("__part", F.spark_partition_id()), "value-counts")
    dealt = dealt.withColumn("__c", F.when(F.col("__v").isNull(), 0).otherwise(F.col("__c")))   # a NULL takes no place
    per = dealt.groupBy(*keys, "__part").agg(F.sum("__c").alias("__pc"))
    group = Window.partitionBy(*keys)                       # rows: the partitions that a group touches
    per = per.withColumn("__before", F.coalesce(F.sum("__pc").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("__n", F.sum("__pc").over(group))
    inside = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn("__upto", F.sum("__c").over(inside))
    on = F.lit(True)
    for k in [*keys, "__part"]:
        on = on & here[k].eqNullSafe(per[k])
    ranked = here.join(per, on).select(*[here[k] for k in keys], "__v", "__n", (F.col("__before") + F.col("__upto")).alias("__hi"),
                                       (F.col("__before") + F.col("__upto") - F.col("__c")).alias("__lo"))
    aggs = []
    for q, name in zip(probs, names):
        place = F.lit(float(q)) * (F.col("__n") - 1)
        at = lambda i: F.max(F.when((F.col("__lo") <= i) & (i < F.col("__hi")), F.col("__v")))
        aggs += [at(F.floor(place)).alias(f"__{name}a"), at(F.ceil(place)).alias(f"__{name}b"), F.max(place - F.floor(place)).alias(f"__{name}f")]
    g = ranked.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[((1 - F.col(f"__{n}f")) * F.col(f"__{n}a") + F.col(f"__{n}f") * F.col(f"__{n}b")).alias(n) for n in names])


def global_bounds(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """First and last timestamp and the number of whole hours spanned (inclusive)."""
    b = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return b.select("first_ts", "last_ts",
                    (F.timestamp_diff("HOUR", F.col("first_ts"), F.col("last_ts")) + 1).alias("total_hours"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """Number of NULLs per column, one row per column (single scan)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def topk_mean(df: DataFrame, key: str, value: str, k: int = 20) -> DataFrame:
    """Mean per key, the ``k`` largest (ties broken by key): a top-k report."""
    return (df.groupBy(key).agg(F.avg(value).alias("mean_value"))
            .orderBy(F.desc("mean_value"), F.asc(key)).limit(k))
