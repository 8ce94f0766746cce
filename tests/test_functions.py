import math

import pytest

from golden_helpers import ts
from wattle.functions import arith, calendar, weather


def col(df, c):
    return [r[c] for r in df.collect()]


def test_area_per_floor(spark):
    df = spark.createDataFrame([(1, 100.0, 4.0), (2, 100.0, 0.0), (3, 100.0, None)], "id int, a double, f double")
    out = df.orderBy("id").select(arith.safe_ratio("a", "f").alias("r"))
    assert col(out, "r") == [25.0, 100.0, None]


def test_clip_zero_keeps_null(spark):
    df = spark.createDataFrame([(1, -1.0), (2, None), (3, 2.0)], "id int, x double")
    assert col(df.orderBy("id").select(arith.clip_zero("x").alias("x")), "x") == [0.0, None, 2.0]


def test_weekday_monday_is_zero(spark):
    df = spark.createDataFrame([(ts("2016-01-04 10:00:00"),)], "t timestamp_ntz")
    assert col(df.select(calendar.weekday_monday0("t").alias("w")), "w") == [0]


def test_month_bucket(spark):
    df = spark.createDataFrame([(i, m) for i, m in enumerate([12, 1, 3, 6, 9])], "i int, m int")
    out = df.orderBy("i").select(calendar.month_bucket("m", calendar.SEASONS).alias("b"))
    assert col(out, "b") == [1, 1, 2, 3, 4]


def test_holiday_flag_and_midnight_variant(spark):
    df = spark.createDataFrame([(0, ts("2016-01-01 00:00:00")), (1, ts("2016-01-01 05:00:00")),
                                (2, ts("2016-01-02 00:00:00"))], "i int, t timestamp_ntz")
    out = df.orderBy("i").select(calendar.holiday_flag("t").alias("h"),
                                 calendar.holiday_flag("t", midnight_only=True).alias("m"))
    assert col(out, "h") == [1, 1, 0]
    assert col(out, "m") == [1, 0, 0]


def test_weekday_collapse_and_weekend(spark):
    days = ["2016-01-04", "2016-01-05", "2016-01-06", "2016-01-07", "2016-01-08", "2016-01-09", "2016-01-10"]
    df = spark.createDataFrame([(i, ts(d + " 00:00:00")) for i, d in enumerate(days)], "i int, t timestamp_ntz")
    out = df.orderBy("i").select(calendar.weekday_collapse(calendar.weekday_monday0("t")).alias("w"),
                                 calendar.weekend_flag("t").alias("we"))
    assert col(out, "w") == [0, 1, 1, 1, 4, 5, 6]
    assert col(out, "we") == [0, 0, 0, 0, 0, 1, 1]


def _feels_py(t_c, rh, v):
    """Independent scalar version of the NWS rules (wind chill / heat index)."""
    if t_c is None:
        return None
    t = t_c * 1.8 + 32.0
    if t <= 50 and v is not None and v > 3:
        return 35.74 + 0.6215 * t - 35.75 * v ** 0.16 + 0.4275 * t * v ** 0.16
    if t >= 80:
        if rh is None:
            return None
        hi = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094)
        if hi >= 80:
            hi = (-42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 6.83783e-3 * t * t
                  - 5.481717e-2 * rh * rh + 1.22874e-3 * t * t * rh + 8.5282e-4 * t * rh * rh
                  - 1.99e-6 * t * t * rh * rh)
            if rh < 13 and t <= 112:
                hi -= (13 - rh) / 4 * math.sqrt((17 - abs(t - 95)) / 17)
            elif rh > 85 and t <= 87:
                hi += (rh - 85) / 10 * ((87 - t) / 5)
        return hi
    return t


def test_feels_like_all_branches(spark):
    rows = []
    i = 0
    for t in (-20.0, 0.0, 5.0, 10.0, 15.0, 26.0, 27.0, 30.0, 35.0, 40.0, 44.0, None):
        for rh in (5.0, 12.0, 40.0, 90.0, None):
            for v in (0.0, 2.0, 3.0, 3.5, 15.0, None):
                rows.append((i, t, rh, v))
                i += 1
    df = spark.createDataFrame(rows, "i int, t double, rh double, v double")
    got = {r["i"]: r["f"] for r in df.select("i", weather.feels_like("t", "rh", "v").alias("f")).collect()}
    for i, t, rh, v in rows:
        exp = _feels_py(t, rh, v)
        if exp is None:
            assert got[i] is None, (t, rh, v)
        else:
            assert got[i] == pytest.approx(exp, rel=1e-12, abs=1e-9), (t, rh, v)


def test_humidity_forms_agree_at_saturation(spark):
    df = spark.createDataFrame([(20.0, 20.0), (30.0, 10.0)], "t double, d double")
    out = df.select(weather.humidity_magnus("t", "d").alias("m"), weather.humidity_base10("t", "d").alias("b")).collect()
    assert out[0]["m"] == pytest.approx(100.0) and out[0]["b"] == pytest.approx(100.0)
    assert 25 < out[1]["m"] < 35 and 25 < out[1]["b"] < 35


def test_log1p_guard(spark):
    from wattle.functions.target import expm1_safe, log1p_safe
    df = spark.createDataFrame([(0, -2.0), (1, 0.0), (2, 9.0)], "i int, x double")
    out = df.orderBy("i").select(log1p_safe("x").alias("l"), expm1_safe(log1p_safe("x")).alias("b")).collect()
    assert out[0]["l"] is None
    assert out[2]["l"] == pytest.approx(math.log(10.0))
    assert out[2]["b"] == pytest.approx(9.0)
