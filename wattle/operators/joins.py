"""Joins of the reading fact to its dimensions.

No broadcast hint is forced on a side whose size depends on the data: the
join is planned as a shuffle join and adaptive execution turns it into a
broadcast hash join only when the side's measured size after its stage is
below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.  That is the size
check, on real run-time statistics, without an extra job.  Hot keys on the
shuffle path are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Equi join fact -> dimension (``how`` = left keeps every fact row)."""
    return fact.join(dim, on, how)


def join_building(readings: DataFrame, buildings: DataFrame, key: str = "building_id",
                  how: str = "left") -> DataFrame:
    return join_dimension(readings, buildings, key, how)


def join_weather(df: DataFrame, weather: DataFrame, keys=("site_id", "timestamp"),
                 how: str = "left") -> DataFrame:
    """Two-key join on (site, hour).  Weather is sites x hours: broadcast when
    the check passes, otherwise a sort-merge join on both keys."""
    return join_dimension(df, weather, list(keys), how)


def join_back(df: DataFrame, agg: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach a per-group aggregate to every row of its group."""
    return join_dimension(df, agg, keys, how)


def join_truth(truth: DataFrame, pred: DataFrame, keys=("building_id", "meter", "timestamp"),
               value: str = "meter_reading", truth_name: str = "meter_reading_true",
               pred_name: str = "meter_reading_pred") -> DataFrame:
    """Truth left-joined to predictions with explicit names for both values
    (what pandas calls ``_x`` / ``_y``)."""
    keys = list(keys)
    t = truth.select(*keys, F.col(value).alias(truth_name))
    p = pred.select(*keys, F.col(value).alias(pred_name))
    return t.join(p, keys, "left")
