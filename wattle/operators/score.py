"""Scores, ensembles and distribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattle.functions.arith import clip_zero
from wattle.functions.target import log1p_safe
from wattle.operators.clean import clip_negative, exclude_entity, fill_const, year_range
from wattle.operators.joins import join_truth
from wattle.session import write_table


def rmse_expr(y: str, p: str):
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def rmse(df: DataFrame, y: str, p: str) -> DataFrame:
    """Root mean squared error plus the rows that had both values and those
    that did not (a NULL prediction fails loudly in the reference; here it is
    counted and reported)."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    return df.agg(rmse_expr(y, p).alias("rmse"),
                  F.count_if(both).alias("n_scored"),
                  F.count_if(~both).alias("n_unmatched"))


def cv_mean_score(df: DataFrame, y: str, p: str, fold: str = "fold") -> DataFrame:
    """Mean over folds of the per-fold RMSE (differs from pooled RMSE), with the rows
    that were scored and those that had no truth or no prediction."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    per = df.groupBy(fold).agg(rmse_expr(y, p).alias("__r"), F.count_if(both).alias("__s"), F.count_if(~both).alias("__u"))
    return per.agg(F.avg("__r").alias("cv_mean_rmse"), F.count(F.lit(1)).alias("n_folds"),
                   F.sum("__s").alias("n_scored"), F.sum("__u").alias("n_unmatched"))


def score_by_segment(df: DataFrame, segment: str, y: str, p: str) -> DataFrame:
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    return df.groupBy(segment).agg(rmse_expr(y, p).alias("rmse"), F.count_if(both).alias("n_scored"),
                                   F.count_if(~both).alias("n_unmatched"))


def ensemble_mean(df: DataFrame, cols: list[str], name: str = "pred_mean") -> DataFrame:
    """Row-wise mean across model columns."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.select("*", (total / F.lit(len(cols))).alias(name))


def ensemble_raw_space(df: DataFrame, cols: list[str], name: str = "meter_reading") -> DataFrame:
    """mean(expm1(p_i)), clipped at 0: average after leaving log space."""
    total = sum((F.expm1(c) for c in cols[1:]), F.expm1(cols[0]))
    return df.select("*", clip_zero(total / F.lit(len(cols))).alias(name))


def ensemble_log_space(df: DataFrame, cols: list[str], name: str = "meter_reading") -> DataFrame:
    """expm1(mean(p_i)), clipped at 0: average in log space, then leave it."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.select("*", clip_zero(F.expm1(total / F.lit(len(cols)))).alias(name))


def holdout_frame(truth: DataFrame, pred: DataFrame, first_year: int, last_year: int,
                  exclude_building, keys=("building_id", "meter", "timestamp"),
                  value: str = "meter_reading", ts: str = "timestamp",
                  building: str = "building_id") -> DataFrame:
    """Truth cleaned the reference's way (fill 0, year range, negatives to 0,
    one building excluded), left-joined to predictions, both in log1p space."""
    t = fill_const(truth, 0, [value])
    t = year_range(t, ts, first_year, last_year)
    t = clip_negative(t, value)
    t = exclude_entity(t, building, exclude_building)
    j = join_truth(t, pred, keys, value)
    return j.select("*", log1p_safe("meter_reading_true").alias("true_l1p"),
                    log1p_safe("meter_reading_pred").alias("pred_l1p"))


def holdout_rmsle(truth: DataFrame, pred: DataFrame, first_year: int, last_year: int,
                  exclude_building, **kw) -> DataFrame:
    return rmse(holdout_frame(truth, pred, first_year, last_year, exclude_building, **kw),
                "true_l1p", "pred_l1p")


def holdout_from_file(spark, predictions_path: str, rows: DataFrame, truth: DataFrame,
                      first_year: int, last_year: int, exclude_building, key: str = "row_id",
                      keys=("building_id", "meter", "timestamp"), value: str = "meter_reading") -> DataFrame:
    """Score a saved prediction file (CSV ``row_id, meter_reading``): attach the
    rows' keys by ``row_id`` (inner join), then the holdout score."""
    from pyspark.sql import types as T

    from wattle.sources.readers import read_csv
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(value, T.DoubleType())])
    saved = read_csv(spark, predictions_path, schema)
    pred = rows.select(key, *keys).join(saved, key, "inner").drop(key)
    return holdout_rmsle(truth, pred, first_year, last_year, exclude_building, keys=keys, value=value)


def distribution_compare(df: DataFrame, a: str, b: str, lo: float, hi: float, bins: int = 20) -> DataFrame:
    """Fixed-bin histograms of two columns side by side: (bin, n_<a>, n_<b>).
    Bin 0 holds values below ``lo``, bin bins+1 values at or above ``hi``."""
    bin_of = lambda c: F.width_bucket(F.col(c), F.lit(lo), F.lit(hi), F.lit(bins))
    pair = F.explode(F.array(F.struct(F.lit(0).alias("which"), bin_of(a).alias("bin")), F.struct(F.lit(1).alias("which"), bin_of(b).alias("bin"))))
    # one pass: both bins of a row, counted together
    rows = df.select(pair.alias("h")).select("h.which", "h.bin").where(F.col("bin").isNotNull())
    return rows.groupBy("bin").agg(F.count_if(F.col("which") == 0).alias(f"n_{a}"), F.count_if(F.col("which") == 1).alias(f"n_{b}"))


def oof_group_mean(df: DataFrame, keys: list[str], target: str, fold: str = "fold",
                   name: str = "oof", segment: str | None = None) -> DataFrame:
    """Leave-fold-out group-mean predictor: a row of fold f is predicted by
    the mean target of its group over the other folds, else by the mean of
    all other folds.  Counts and sums are subtracted, so one pass serves
    every fold (the SQL-checkable stand-in for out-of-fold model predictions).
    With ``segment`` every segment value is treated as a data set of its own."""
    part = [segment] if segment else []
    keys = [*part, *keys]
    # (keys, fold) sums are aggregated once; totals and fold means come from that small table
    kf = write_table(df.groupBy(*keys, fold).agg(F.count(target).alias("__nkf"), F.sum(target).alias("__skf")), "key-fold-sums")
    k = kf.groupBy(*keys).agg(F.sum("__nkf").alias("__nk"), F.sum("__skf").alias("__sk"))
    stats = kf.join(k, keys, "inner").select(
        *keys, fold, (F.col("__nk") - F.col("__nkf")).alias("__n"),
        (F.col("__sk") - F.col("__skf")).alias("__s"))
    f = kf.groupBy(*part, fold).agg(F.sum("__nkf").alias("__nf"), F.sum("__skf").alias("__sf"))
    others = Window.partitionBy(*part)                            # rows: the folds (of a segment)
    fmean = f.select(*part, fold, ((F.sum("__sf").over(others) - F.col("__sf"))
                                   / (F.sum("__nf").over(others) - F.col("__nf"))).alias("__fm"))
    # one row per fold without segments; with them the planner sizes it
    j = df.join(stats, keys + [fold], "left").join(fmean if segment else F.broadcast(fmean), [*part, fold], "left")
    pred = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).otherwise(F.col("__fm"))
    return j.select(*df.columns, pred.alias(name))
