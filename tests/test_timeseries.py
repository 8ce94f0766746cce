import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from golden_helpers import ts
from wattle.operators import timeseries as T

VALS = [1, 2, 4, 8, 16.5, 3, 7.25]


def _series(spark, values, site=0, start="2016-01-01 00:00:00"):
    base = pd.Timestamp(start)
    rows = [(site, (base + pd.Timedelta(hours=i)).to_pydatetime(), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site_id int, timestamp timestamp_ntz, x double")


def test_interpolation_golden(spark):
    df = _series(spark, [None, 1, None, None, 4, None])
    out = T.interpolate_linear(df, ["x"]).orderBy("timestamp")
    assert [r.x for r in out.collect()] == [1, 1, 2, 3, 4, 4]


def test_interpolation_matches_pandas(spark):
    rnd = random.Random(3)
    frames = []
    for site in range(3):
        vals = [None if rnd.random() < 0.4 else rnd.uniform(-5, 5) for _ in range(60)]
        frames.append(_series(spark, vals, site))
    df = frames[0].unionByName(frames[1]).unionByName(frames[2])
    got = T.interpolate_linear(df, ["x"]).toPandas().sort_values(["site_id", "timestamp"])
    pdf = df.toPandas().sort_values(["site_id", "timestamp"])
    exp = pdf.groupby("site_id")["x"].transform(lambda s: s.interpolate(limit_direction="both"))
    np.testing.assert_allclose(got["x"].to_numpy(dtype=float), exp.to_numpy(dtype=float), rtol=1e-12)


def test_rolling_golden(spark):
    df = _series(spark, VALS)
    out = T.rolling_stats(df, ["x"], window=4).orderBy("timestamp").collect()
    assert [r.x_median_lag4 for r in out] == [1, 1.5, 2, 3, 6, 6, 7.625]
    assert out[0].x_std_lag4 is None
    assert out[0].x_skew_lag4 is None and out[1].x_skew_lag4 is None
    assert out[2].x_skew_lag4 == pytest.approx(0.935219529582, abs=1e-10)


def test_rolling_matches_pandas(spark):
    rnd = random.Random(5)
    vals = [None if rnd.random() < 0.2 else rnd.uniform(0, 30) for _ in range(80)]
    df = _series(spark, vals)
    got = T.rolling_stats(df, ["x"], window=18).orderBy("timestamp").toPandas()
    s = pd.Series([np.nan if v is None else v for v in vals])
    r = s.rolling(18, min_periods=0)
    for stat, exp in [("mean", r.mean()), ("median", r.median()), ("min", r.min()), ("max", r.max()),
                      ("std", r.std()), ("skew", r.skew())]:
        np.testing.assert_allclose(got[f"x_{stat}_lag18"].to_numpy(dtype=float), exp.to_numpy(), rtol=1e-9,
                                   atol=1e-9, err_msg=stat)


def test_gap_fill_spine_and_union(spark):
    rows = [(0, ts("2016-01-01 00:00:00"), 1.0), (0, ts("2016-01-01 03:00:00"), 2.0),
            (1, ts("2016-01-01 01:00:00"), 5.0)]
    df = spark.createDataFrame(rows, "site_id int, timestamp timestamp_ntz, x double")
    out = T.gap_fill(df)
    assert out.count() == 2 * 4                                  # sites x hours
    assert out.select("site_id", "timestamp").distinct().count() == 8
    assert out.filter(F.col("x").isNotNull()).count() == 3        # originals kept
    assert T.missing_hours(df).count() == 5


def test_group_mean_fill_empty_group(spark):
    # site 0 has a day whose values are all NULL; site 1 starts with an all-NULL day
    rows = [(0, ts("2016-01-01 00:00:00"), 1.0), (0, ts("2016-01-01 01:00:00"), 3.0),
            (0, ts("2016-01-02 00:00:00"), None), (1, ts("2016-01-01 00:00:00"), None),
            (1, ts("2016-01-02 00:00:00"), 7.0), (0, ts("2017-01-01 00:00:00"), 5.0)]
    df = spark.createDataFrame(rows, "site_id int, timestamp timestamp_ntz, x double")
    mean = {(r.site_id, str(r.timestamp)): r.x for r in T.impute_group_mean(df, ["x"]).collect()}
    assert mean[(0, "2016-01-02 00:00:00")] is None
    ff = {(r.site_id, str(r.timestamp)): r.x for r in T.impute_group_ffill(df, ["x"]).collect()}
    # (site 0, day 2, month 1) takes the previous group in key order: (0, 1, 1) -> mean(1, 3, 5) = 3
    assert ff[(0, "2016-01-02 00:00:00")] == pytest.approx(3.0)
    # the year is not a key: (0, 1, 1) mixes 2016 and 2017
    assert mean[(0, "2016-01-01 00:00:00")] == 1.0
    # site 1 first group is empty: key order reaches back into site 0's last group (0, 2, 1) -> itself empty -> 3
    assert ff[(1, "2016-01-01 00:00:00")] == pytest.approx(3.0)
    within = {(r.site_id, str(r.timestamp)): r.x for r in T.impute_group_ffill(df, ["x"], across_sites=False).collect()}
    assert within[(1, "2016-01-01 00:00:00")] is None


def _ref_ffill(pdf):
    """pandas form of the reference: group means in (site, day, month) order, ffill, fill-only update."""
    pdf = pdf.copy()
    pdf["day"] = pdf.timestamp.dt.day
    pdf["month"] = pdf.timestamp.dt.month
    m = pdf.groupby(["site_id", "day", "month"])["x"].mean().ffill()
    key = list(zip(pdf.site_id, pdf.day, pdf.month))
    return pdf["x"].fillna(pd.Series([m[k] for k in key], index=pdf.index))


def test_ffill_matches_pandas(spark):
    rnd = random.Random(11)
    rows = []
    for site in range(4):
        for h in range(24 * 40):
            t = pd.Timestamp("2016-01-01") + pd.Timedelta(hours=h)
            empty_day = (t.day + site) % 9 == 0
            v = None if (empty_day or rnd.random() < 0.3) else rnd.uniform(0, 10)
            rows.append((site, t.to_pydatetime(), v))
    df = spark.createDataFrame(rows, "site_id int, timestamp timestamp_ntz, x double")
    got = T.impute_group_ffill(df, ["x"]).toPandas().sort_values(["site_id", "timestamp"]).reset_index(drop=True)
    pdf = df.toPandas().sort_values(["site_id", "timestamp"]).reset_index(drop=True)
    np.testing.assert_allclose(got["x"].to_numpy(dtype=float), _ref_ffill(pdf).to_numpy(dtype=float), rtol=1e-12)


def test_leads_stay_inside_site(spark):
    df = _series(spark, [1, 2, 3]).unionByName(_series(spark, [10, 20], site=1))
    out = {(r.site_id, r.x): r for r in T.lead_features(df, "x").collect()}
    assert out[(0, 3.0)].x_lead1 is None
    assert out[(0, 1.0)].x_lead2 == 3.0
    assert out[(1, 10.0)].x_lead1 == 20.0 and out[(1, 10.0)].x_lead2 is None


def test_combined_fills_equal_separate(spark):
    rnd = random.Random(21)
    rows = []
    for site in range(3):
        for h in range(24 * 20):
            t = pd.Timestamp("2016-02-01") + pd.Timedelta(hours=h)
            gone = (t.day + site) % 7 == 0
            rows.append((site, t.to_pydatetime(), None if gone or rnd.random() < 0.3 else rnd.uniform(0, 9),
                         None if gone or rnd.random() < 0.3 else rnd.uniform(0, 9)))
    df = spark.createDataFrame(rows, "site_id int, timestamp timestamp_ntz, a double, b double")
    sep = T.impute_group_ffill(T.impute_group_mean(df, ["a"]), ["b"]).toPandas()
    comb = T.impute_group_fills(df, ["a"], ["b"]).toPandas()
    key = ["site_id", "timestamp"]
    sep, comb = sep.sort_values(key).reset_index(drop=True), comb.sort_values(key).reset_index(drop=True)
    np.testing.assert_allclose(sep[["a", "b"]].to_numpy(dtype=float), comb[["a", "b"]].to_numpy(dtype=float))
