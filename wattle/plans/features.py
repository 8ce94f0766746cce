"""Feature frames: the reference's per-meter / pooled / per-site pipelines as
one lazy plan from raw tables to model-ready rows.

Plan shape (readings are the only large input):

    readings --anti(bad rows)--> --left(buildings)-->
      --left(weather features on (site, hour))-->
      calendar + buckets + log target

Weather features are computed once on the sites x hours table (small) and
shared by every meter; nothing is rebuilt per segment.  Both derived
dimensions (weather and building features) are written once to the shared
folder: the fact-side joins then see their real size, so the planner
broadcasts them when they are small and the readings are never shuffled to
meet a few thousand dimension rows; a large building table falls back to a
sort-merge join on building_id (AQE splits hot buildings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.arith import safe_ratio, unit_convert
from wattle.functions.calendar import (
    REFERENCE_HOLIDAYS, SEASONS, THIRDS, holiday_flag, month_bucket, weekday_collapse,
)
from wattle.functions.target import log1p_safe
from wattle.functions.weather import feels_like, humidity_magnus
from wattle.operators.aggregate import profile_fold_safe, profile_full, profile_mean_median
from wattle.operators.clean import drop_bad_rows, drop_startup_outliers
from wattle.operators.encode import label_encode, target_encode, target_encode_oof
from wattle.operators.folds import folds_kfold
from wattle.operators.joins import join_back, join_building, join_weather
from wattle.operators.timeseries import (
    gap_fill, impute_group_fills, interpolate_linear, lead_features, rolling_stats,
)
from wattle.session import materialize, write_table

MEAN_FILLED = ["air_temperature", "dew_temperature", "wind_direction", "wind_speed"]
FFILL_FILLED = ["cloud_coverage", "precip_depth_1_hr", "sea_level_pressure"]


def weather_features(weather: DataFrame, mean_cols=MEAN_FILLED, ffill_cols=FFILL_FILLED,
                     leads: bool = True, across_sites: bool = True) -> DataFrame:
    """Spine + fills + relative humidity + feels-like + 1..3 hour look-ahead.
    (The input is read by several branches; pass a table, not a heavy plan.)
    The gap-filled table (sites x hours) feeds every fill, so it is
    materialized once instead of being re-derived in each branch."""
    w = materialize(gap_fill(weather))
    w = impute_group_fills(w, list(mean_cols), list(ffill_cols), across_sites=across_sites)
    w = w.withColumn("relative_humidity", humidity_magnus("air_temperature", "dew_temperature"))
    w = w.withColumn("feels_like", feels_like("air_temperature", "relative_humidity", "wind_speed"))
    if leads:
        w = lead_features(w, "air_temperature")
    return w


def building_features(buildings: DataFrame, unit_site: int = 1, unit_exempt=(150, 106),
                      factor: float = 10.7639) -> DataFrame:
    """Encoded use, unit fix for one site, area per floor, both areas in log1p."""
    b = label_encode(buildings, "primary_use")
    cond = F.col("site_id").isin(unit_site) & ~F.col("building_id").isin(*unit_exempt)
    b = b.withColumn("square_feet", unit_convert("square_feet", cond, factor))
    b = b.withColumn("square_feet_floor", safe_ratio("square_feet", "floor_count"))
    return (b.withColumn("square_feet", log1p_safe("square_feet"))
             .withColumn("square_feet_floor", log1p_safe("square_feet_floor")))


def calendar_features(df: DataFrame, ts: str = "timestamp", holidays=REFERENCE_HOLIDAYS,
                      midnight_only: bool = False) -> DataFrame:
    """hour, weekday (Tue-Thu collapsed), day of year, holiday flag, season
    (``month``) and third of year (``group``)."""
    t = F.col(ts)
    return df.select(
        "*",
        F.hour(t).alias("hour"),
        weekday_collapse(F.weekday(t)).alias("day_of_week"),
        F.dayofyear(t).alias("year_day"),
        holiday_flag(t, holidays, midnight_only).alias("is_holiday"),
        month_bucket(F.month(t), SEASONS).alias("month"),
        month_bucket(F.month(t), THIRDS).alias("group"),
    )


def training_frame(readings: DataFrame, buildings: DataFrame, weather: DataFrame,
                   bad_rows: DataFrame | None = None, holidays=REFERENCE_HOLIDAYS,
                   weather_ready: bool = False, drop=("sea_level_pressure", "wind_direction",
                                                      "wind_speed")) -> DataFrame:
    """Model-ready training rows: one per kept reading, target in log1p."""
    r = drop_bad_rows(readings, bad_rows) if bad_rows is not None else readings
    b = write_table(building_features(buildings), "building-features")
    w = weather if weather_ready else write_table(weather_features(weather), "weather-features")
    df = join_weather(join_building(r, b), w)
    df = calendar_features(df, holidays=holidays)
    df = df.withColumn("meter_reading", log1p_safe("meter_reading"))
    return df.drop(*drop)


def scoring_frame(rows: DataFrame, buildings: DataFrame, weather: DataFrame,
                  holidays=REFERENCE_HOLIDAYS, weather_ready: bool = False,
                  drop=("sea_level_pressure", "wind_direction", "wind_speed")) -> DataFrame:
    """Rows to predict with the same features (no target)."""
    b = write_table(building_features(buildings), "building-features")
    w = weather if weather_ready else write_table(weather_features(weather), "weather-features")
    df = join_weather(join_building(rows, b), w)
    return calendar_features(df, holidays=holidays).drop(*drop)


PROFILE_STATS = ("mean", "median", "std")


def profiled_training_frame(train: DataFrame, k: int = 3, keys=("building_id", "meter"), target: str = "meter_reading",
                            encoded: str = "building_id") -> DataFrame:
    """Training rows with contiguous folds, the target's profile by ``keys`` and the target
    encoding of ``encoded``, both from the rows of the other folds only."""
    rows = write_table(folds_kfold(train.filter(F.col(target).isNotNull()), k, "row_id"), "profiled-rows")
    profile = profile_fold_safe(rows, list(keys), target, "fold", k, PROFILE_STATS)
    return target_encode_oof(join_back(rows, profile, [*keys, "fold"]), encoded, target, "fold")


def profiled_scoring_frame(train: DataFrame, scoring: DataFrame, keys=("building_id", "meter"), target: str = "meter_reading",
                           encoded: str = "building_id") -> DataFrame:
    """Scoring rows with the profile and the encoding of all training rows: a key that
    training never saw has NULL statistics and the mean target as its encoding."""
    train = train.filter(F.col(target).isNotNull())
    profile = profile_full(train, list(keys), target, stats=PROFILE_STATS)
    return target_encode(train, encoded, target, apply_to=join_back(scoring, profile, list(keys)))


SITE_WEATHER = ["air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr"]


def site_training_frame(readings: DataFrame, buildings: DataFrame, weather: DataFrame,
                        outlier: dict, window: int = 18, weather_cols=SITE_WEATHER, scoring: DataFrame | None = None) -> DataFrame:
    """The per-site pipeline's training rows or, with ``scoring`` (rows without a
    target), those rows with the training rows' profiles: unseen keys get NULLs.

    Weather: interpolated per site over its own rows, plus trailing
    ``window``-row statistics (both tables sites x hours, written once).
    Readings: inner join to encoded buildings, left join to interpolated
    weather, start-up outlier rule, log target, hour and weekday, mean and
    median of the log target per (building, meter) and per
    (building, meter, hour) joined back (inner), then the rolling weather
    statistics joined on (site, hour).
    """
    cols = list(weather_cols)
    w = weather.select("site_id", "timestamp", *cols)
    wi = write_table(interpolate_linear(w, cols), "weather-interpolated")
    lags = write_table(rolling_stats(wi, cols, window, drop_source=True), "weather-lags")
    b = write_table(label_encode(buildings, "primary_use"), "buildings-encoded")
    hours = [F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("weekday")]
    df = join_weather(join_building(readings, b, how="inner"), wi)
    df = drop_startup_outliers(df, **outlier)
    # written once: the rows and both profiles read it, the profiles only their columns
    df = write_table(df.select("*", log1p_safe("meter_reading").alias("log_meter_reading"), *hours), "site-rows")
    keys = ["building_id", "meter"]
    p1 = profile_mean_median(df, keys, "log_meter_reading", "building_meter")
    p2 = profile_mean_median(df, keys + ["hour"], "log_meter_reading", "building_meter_hour")
    if scoring is not None:
        df = join_weather(join_building(scoring, b), wi).select("*", *hours)
    how = "inner" if scoring is None else "left"
    df = join_back(join_back(df, p1, keys, how), p2, keys + ["hour"], how)
    return join_weather(df, lags)
