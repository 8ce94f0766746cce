"""Categorical encodings, fitted once and applied by join.

Label encoding: sorted distinct values -> 0..k-1 (``range_rank`` over the
distinct table).  Target encoding: per-key count and
sum joined back; the fold-safe variant subtracts each fold's own counts and
sums from the key totals, so every fold is encoded from the other folds in
one pass (no per-fold loop, no leak).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattle.session import write_table
from wattle.sources.positions import range_rank


def fit_label_encoder(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Mapping (value, code) with codes in ascending value order."""
    out = out or f"{col}_code"
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    return range_rank(d, [col], out).withColumn(out, F.col(out).cast("int"))


def apply_label_encoder(df: DataFrame, mapping: DataFrame, col: str, replace: bool = True) -> DataFrame:
    code = [c for c in mapping.columns if c != col][0]
    j = df.join(mapping, col, "left")
    if replace:
        return j.select(*[F.col(code).alias(col) if c == col else F.col(c) for c in df.columns])
    return j.select(*df.columns, code)


def label_encode(df: DataFrame, col: str, replace: bool = True) -> DataFrame:
    return apply_label_encoder(df, fit_label_encoder(df, col), col, replace)


def _smooth(n, mean, prior, min_samples_leaf: int, smoothing: float):
    s = 1.0 / (1.0 + F.exp(-(n - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    return F.when(n == 1, prior).otherwise(prior * (1 - s) + mean * s)


def fit_target_encoder(train: DataFrame, key: str, target: str, min_samples_leaf: int = 1,
                       smoothing: float = 1.0, out: str | None = None) -> tuple[DataFrame, float]:
    """(per-key encoding table, prior).

    prior = mean target; a key with n rows and mean m gets
    ``prior*(1-s) + m*s`` with ``s = 1/(1+exp(-(n - min_samples_leaf)/smoothing))``;
    a key seen once gets the prior.
    """
    out = out or f"{key}_te"
    stats = write_table(train.groupBy(key).agg(F.count(target).alias("__n"), F.sum(target).alias("__s")), "key-sums")
    prior = stats.agg(F.sum("__s") / F.sum("__n")).first()[0]          # one scalar, from the sums
    stats = stats.withColumn("__m", F.col("__s") / F.when(F.col("__n") > 0, F.col("__n")))
    enc = stats.select(key, _smooth(F.col("__n"), F.col("__m"), F.lit(prior), min_samples_leaf,
                                    smoothing).alias(out))
    return enc, prior


def apply_target_encoder(df: DataFrame, enc: DataFrame, prior: float, key: str,
                         out: str | None = None) -> DataFrame:
    """Unseen keys get the prior."""
    out = out or [c for c in enc.columns if c != key][0]
    j = df.join(enc, key, "left")
    return j.select(*df.columns, F.coalesce(F.col(out), F.lit(prior)).alias(out))


def target_encode(train: DataFrame, key: str, target: str, apply_to: DataFrame | None = None,
                  min_samples_leaf: int = 1, smoothing: float = 1.0, out: str | None = None) -> DataFrame:
    enc, prior = fit_target_encoder(train, key, target, min_samples_leaf, smoothing, out)
    return apply_target_encoder(train if apply_to is None else apply_to, enc, prior, key, out)


def target_encode_oof(df: DataFrame, key: str, target: str, fold: str, min_samples_leaf: int = 1,
                      smoothing: float = 1.0, out: str | None = None) -> DataFrame:
    """Fold-safe target encoding: rows of fold f are encoded from rows of the
    other folds only (counts and sums are subtractable)."""
    out = out or f"{key}_te"
    kf = write_table(df.groupBy(key, fold).agg(F.count(target).alias("__nkf"), F.sum(target).alias("__skf")), "key-fold-sums")
    k = kf.groupBy(key).agg(F.sum("__nkf").alias("__nk"), F.sum("__skf").alias("__sk"))
    f = kf.groupBy(fold).agg(F.sum("__nkf").alias("__nf"), F.sum("__skf").alias("__sf"))
    allf = Window.partitionBy()                               # over the k-row fold table
    fprior = f.select(fold, ((F.sum("__sf").over(allf) - F.col("__sf"))
                             / (F.sum("__nf").over(allf) - F.col("__nf"))).alias("__prior"))
    stats = kf.join(k, key, "inner").select(
        key, fold, (F.col("__nk") - F.col("__nkf")).alias("__n"),
        (F.col("__sk") - F.col("__skf")).alias("__s"))
    j = (df.join(stats, [key, fold], "left")
         .join(F.broadcast(fprior), fold, "left"))   # one row per fold: bounded by k
    n, prior = F.col("__n"), F.col("__prior")
    enc = F.when(n > 0, _smooth(n, F.col("__s") / n, prior, min_samples_leaf, smoothing)).otherwise(prior)
    return j.select(*df.columns, enc.alias(out))
