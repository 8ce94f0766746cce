import random

import numpy as np
import pandas as pd
import pytest

from wattle.operators import aggregate as A

VALS = [1, 2, 4, 8, 16.5, 3, 7.25]


def test_profile_golden(spark):
    df = spark.createDataFrame([(0, float(v)) for v in VALS], "k int, x double")
    r = A.profile_full(df, ["k"], "x").collect()[0]
    assert r.x_skew == pytest.approx(1.490580436006, abs=1e-11)
    assert r.x_kurt == pytest.approx(2.342160990090, abs=1e-11)
    assert r.x_mad == pytest.approx(3.959183673469, abs=1e-11)
    assert r.x_q80 == pytest.approx(7.85)
    assert r.x_ptp == 15.5 and r.x_median == 4.0


def test_profile_matches_pandas(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.uniform(0, 100)) for k in range(6) for _ in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(rows, "k int, x double")
    got = A.profile_full(df, ["k"], "x").toPandas().set_index("k").sort_index()
    pdf = pd.DataFrame(rows, columns=["k", "x"])
    g = pdf.groupby("k")["x"]
    exp = pd.DataFrame({"max": g.max(), "mean": g.mean(), "std": g.std(), "skew": g.skew(),
                        "median": g.median(), "q80": g.quantile(0.8), "q30": g.quantile(0.3),
                        "kurt": g.apply(pd.Series.kurt), "mad": g.apply(lambda s: (s - s.mean()).abs().mean()),
                        "ptp": g.max() - g.min()})
    for c in exp.columns:
        np.testing.assert_allclose(got[f"x_{c}"].to_numpy(dtype=float), exp[c].to_numpy(dtype=float),
                                   rtol=1e-9, atol=1e-9, err_msg=c)


def test_null_profile_and_bounds(spark):
    import datetime as dt
    df = spark.createDataFrame([(1, None, dt.datetime(2016, 1, 1, 0)), (None, 2.0, dt.datetime(2016, 1, 1, 5))],
                               "a int, b double, t timestamp_ntz")
    nulls = {r.column_name: r.n_null for r in A.null_profile(df).collect()}
    assert nulls == {"a": 1, "b": 1, "t": 0}
    b = A.global_bounds(df, "t").collect()[0]
    assert b.total_hours == 6


def test_topk_is_ordered(spark):
    df = spark.createDataFrame([(k, float(k % 7)) for k in range(50)], "k int, v double")
    out = A.topk_mean(df, "k", "v", 5).collect()
    assert [r.mean_value for r in out] == [6.0] * 5
    assert [r.k for r in out] == [6, 13, 20, 27, 34]


def test_profile_fold_safe_equals_refit(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(12)
    rows = [(i, rnd.randint(0, 3), rnd.uniform(0, 9), i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, k int, x double, fold int")
    got = {(r.k, r.fold): r for r in A.profile_fold_safe(df, ["k"], "x", "fold", 3).collect()}
    for f in range(3):
        ref = A.profile_mean_median(df.filter(F.col("fold") != f), ["k"], "x", "s").collect()
        for r in ref:
            g = got[(r.k, f)]
            assert g.x_mean == pytest.approx(r.mean_s) and g.x_median == pytest.approx(r.median_s)


def test_approximate_quantiles_close_to_exact(spark):
    rnd = random.Random(30)
    rows = [(k, rnd.uniform(0, 100)) for k in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, x double")
    ex = {r.k: r for r in A.quantiles(df, ["k"], "x", (0.3, 0.8)).collect()}
    ap = {r.k: r for r in A.quantiles(df, ["k"], "x", (0.3, 0.8), exact=False).collect()}
    for k in ex:
        assert abs(ex[k].q30 - ap[k].q30) < 1.0 and abs(ex[k].q80 - ap[k].q80) < 1.0
