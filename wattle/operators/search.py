"""Guided parameter search: a known good point, random points, then points that a surrogate
proposes from all trials before.

Every trial is cross-validated by the fleet trainer: the first points, and the ``batch``
points proposed together, are one fleet (point x fold) and cost the Spark jobs of a single
model.  All fleets grow on the same blocks, packed once.  Trials are rows of a table in the shared folder, written as they end; a search that
is started again on the same table goes on after the last one and ends with the same table,
as proposals depend on the seed, the trial's number and the trials before alone.

The surrogate is a Gaussian process over the unit cube of the ranges, on at most a few dozen
trials, in numpy in the driver; the point of highest expected improvement among seeded
candidates (spread over the cube, and around the best trials) is next.
"""

from __future__ import annotations

from dataclasses import replace
from math import erf, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattle.operators.binning import Bins
from wattle.operators.leafwise import LeafwiseParams, grow_fleet, pack
from wattle.session import remove_table

# The ranges that are searched, whole numbers where both ends are integers,
# and the known good point that comes first.
RANGES: dict[str, tuple] = {
    "min_child_weight": (3, 50), "feature_fraction": (0.3, 1.0), "num_leaves": (30, 1300), "bagging_fraction": (0.3, 1.0),
    "bagging_freq": (1, 10), "lambda_l2": (0.1, 2.0), "min_data_in_leaf": (1, 150)}
KNOWN: dict[str, float] = {
    "bagging_freq": 9, "lambda_l2": 0.20866961853961202, "min_child_weight": 47, "feature_fraction": 0.4816474356267998,
    "bagging_fraction": 0.8211493228794307, "num_leaves": 1295, "min_data_in_leaf": 147}
N_RANDOM, N_GUIDED = 5, 40
CANDIDATES = 2048


def to_point(cube: np.ndarray, ranges: dict[str, tuple]) -> dict[str, float]:
    """A point of the unit cube in the units of the ranges."""
    out = {}
    for x, (name, (lo, hi)) in zip(cube, ranges.items(), strict=True):
        v = lo + float(x) * (hi - lo)
        out[name] = int(min(hi, max(lo, round(v)))) if isinstance(lo, int) and isinstance(hi, int) else v
    return out


def to_cube(point: dict[str, float], ranges: dict[str, tuple]) -> np.ndarray:
    return np.array([(point[n] - lo) / (hi - lo) for n, (lo, hi) in ranges.items()])


def surrogate(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation at ``at`` of a Gaussian process through the trials; the
    length scale is the one, of a few, under which the trials are likeliest."""
    shift, scale = y.mean(), y.std() or 1.0
    z, best = (y - shift) / scale, None
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for length in (0.2, 0.4, 0.8, 1.6):
        k = np.exp(-far / (2 * length**2)) + 1e-4 * np.eye(len(x))
        low = np.linalg.cholesky(k)
        w = np.linalg.solve(low.T, np.linalg.solve(low, z))
        fit = -0.5 * z @ w - np.log(np.diag(low)).sum()
        if best is None or fit > best[0]:
            best = fit, length, low, w
    _, length, low, w = best
    cross = np.exp(-((at[:, None] - x[None]) ** 2).sum(axis=2) / (2 * length**2))
    v = np.linalg.solve(low, cross.T)
    return cross @ w * scale + shift, np.sqrt(np.maximum(1.0 - (v**2).sum(axis=0), 1e-12)) * scale


def expected_improvement(mean: np.ndarray, std: np.ndarray, best: float) -> np.ndarray:
    z = (best - mean) / std
    cdf = 0.5 * (1 + np.vectorize(erf)(z / sqrt(2)))
    return (best - mean) * cdf + std * np.exp(-z**2 / 2) / sqrt(2 * pi)


def propose(trials: list[tuple[dict, float]], ranges: dict[str, tuple], n: int, seed: int, number: int) -> list[dict]:
    """The next ``n`` points after ``trials`` (point, error).  Points proposed together are
    told apart by taking each, once proposed, as a trial with its expected error."""
    rng = np.random.Generator(np.random.PCG64([seed, number]))
    x = np.array([to_cube(p, ranges) for p, _ in trials])
    y = np.array([e for _, e in trials])
    out = []
    for _ in range(n):
        near = x[np.argsort(y, kind="stable")[:3]]
        around = np.clip(np.repeat(near, CANDIDATES // 12, axis=0) + rng.normal(0, 0.1, (len(near) * (CANDIDATES // 12), x.shape[1])), 0, 1)
        cand = np.concatenate([rng.random((CANDIDATES, x.shape[1])), around])
        mean, std = surrogate(x, y, cand)
        k = int(expected_improvement(mean, std, y.min()).argmax())
        out.append(to_point(cand[k], ranges))
        x, y = np.vstack([x, to_cube(out[-1], ranges)]), np.append(y, mean[k])
    return out


def _read(spark, path: str, names: list[str]) -> list[tuple[dict, float]]:
    """Finished trials in order; a table that is not there yet has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return []
    rows = spark.read.schema(_schema(names)).parquet(path).orderBy("trial").collect()        # one row a trial
    return [({n: r[n] for n in names}, r["rmse"]) for i, r in enumerate(rows) if r["trial"] == i]


def _schema(names: list[str]) -> str:
    return ", ".join(["trial int", "kind string", *[f"{n} double" for n in names], "rmse double", "trees double"])


def guided_search(df: DataFrame, features: list[str], label: str, fold: str, path: str, base: LeafwiseParams | None = None,
                  ranges: dict[str, tuple] | None = None, known: dict[str, float] | None = None, n_random: int = N_RANDOM,
                  n_guided: int = N_GUIDED, batch: int = 1, seed: int = 7, categories: dict[str, int] | None = None,
                  max_bins: int = 63, bins: Bins | None = None) -> DataFrame:
    """The trial table at ``path`` (in the shared folder) once all trials have ended: trial,
    kind (known, random, guided), the parameters, rmse (mean over the folds of the best
    validation error), trees (mean number) and best_rmse so far.  ``df`` is a written table."""
    spark = df.sparkSession
    ranges, known, base = ranges or RANGES, known or KNOWN, base or LeafwiseParams()
    names = list(ranges)
    whole = {n for n, (lo, hi) in ranges.items() if isinstance(lo, int) and isinstance(hi, int)}
    rng = np.random.Generator(np.random.PCG64(seed))
    first = [("known", {n: known[n] for n in names})] + [("random", to_point(x, ranges)) for x in rng.random((n_random, len(names)))]
    trials, packed = _read(spark, path, names), None
    while (done := len(trials)) < len(first) + n_guided:
        if done < len(first):
            todo = first[done:]
        else:
            n = min(batch - (done - len(first)) % batch, len(first) + n_guided - done)
            start = done - (done - len(first)) % batch                      # a broken batch is proposed as it was
            same = propose(trials[:start], ranges, batch, seed, start)
            todo = [("guided", p) for p in same[done - start:done - start + n]]
        points = [replace(base, **{n: int(v) if n in whole else float(v) for n, v in p.items()}) for _, p in todo]
        packed = packed or pack(df, features, label, fold=fold, categories=categories, max_bins=max_bins, bins=bins)
        fleet = grow_fleet(spark, packed, points)
        rows = []
        for i, (kind, p) in enumerate(todo):
            models = [m for k, m in fleet.models.items() if k[2] == i]
            error = float(np.mean([min(m.history) for m in models]))
            rows.append((done + i, kind, *[float(p[n]) for n in names], error, float(np.mean([m.best for m in models]))))
            trials.append(({n: float(p[n]) for n in names}, error))
        spark.createDataFrame(rows, _schema(names)).coalesce(1).write.mode("append").parquet(path)
    if packed:
        remove_table(spark, packed.path)
    table = spark.read.schema(_schema(names)).parquet(path)
    so_far = F.min("rmse").over(Window.orderBy("trial"))                    # one row a trial
    return table.withColumn("best_rmse", so_far)
