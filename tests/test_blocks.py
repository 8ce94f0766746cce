"""Operators by block of time against the per-site windows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from wattle.operators import blocks, timeseries


@pytest.fixture(scope="module")
def weather(spark):
    r = random.Random(2)
    rows = []
    for site in (0, 1, 2, None):
        for h in sorted(r.sample(range(-40, 260), 150 if site != 2 else 3)):
            t = dt.datetime(1970, 1, 1) + dt.timedelta(hours=h)             # about the start of the block count
            rows.append((site, t, None if r.random() < 0.6 or site == 1 and 30 < h < 200 else r.random(), None if site == 0 else float(r.randint(0, 5)), h))
    return spark.createDataFrame(rows, "site_id long, timestamp timestamp_ntz, x double, y double, hour long").repartition(3).cache()


def rows(df):
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("hours", [3, 24, 10 ** 6])
def test_blocks_equal_sites(spark, weather, hours):
    cols = ["x", "y"]
    assert rows(blocks.interpolate_blocks(weather, cols, hours=hours)) == rows(timeseries.interpolate_linear(weather, cols))
    assert rows(blocks.rolling_stats_blocks(weather, cols, 18, hours=hours)) == rows(timeseries.rolling_stats(weather, cols, 18))
    assert rows(blocks.lead_features_blocks(weather, "x", hours=hours)) == rows(timeseries.lead_features(weather, "x"))


def test_halo_is_no_more_than_the_rows_that_reach_over(spark, weather):
    h = blocks.with_halo(weather, 5, 2, ["x"], hours=24)
    per = {(r.site_id, r["__block"]): r for r in h.groupBy("site_id", "__block").agg({"*": "count"}).collect()}
    real = {(r.site_id, r["__block"]): r["count"] for r in h.filter("__real").groupBy("site_id", "__block").count().collect()}
    assert set(per) == set(real) and sum(real.values()) == weather.count()
    assert all(per[b]["count(1)"] - real[b] <= 7 for b in per)


def test_ties_missing_times_and_empty_tables(spark):
    t = dt.datetime(2016, 1, 1)
    df = spark.createDataFrame([(1, t, 2.0), (1, t, 1.0), (1, None, 4.0), (1, t + dt.timedelta(hours=30), None), (1, t + dt.timedelta(hours=60), 5.0)],
                               "site_id long, timestamp timestamp_ntz, x double")
    got = sorted(((r.timestamp or dt.datetime.min, r.x, r.x_lead1) for r in blocks.lead_features_blocks(df, "x", (1,), hours=24).collect()), key=str)
    assert [g[1:] for g in got] == [(4.0, 1.0), (1.0, 2.0), (2.0, None), (None, 5.0), (5.0, None)]
    assert sorted(r.x for r in blocks.interpolate_blocks(df, ["x"], hours=24).collect()) == [1.0, 2.0, 3.5, 4.0, 5.0]
    empty = df.limit(0)
    assert blocks.rolling_stats_blocks(empty, ["x"]).count() == blocks.interpolate_blocks(empty, ["x"]).count() == 0
