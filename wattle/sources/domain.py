"""Loaders for the domain's own CSV inputs (FIXTURES.md §1 schemas).

Readings get their file position as ``row_id`` (what the bad-row list
refers to); every file is read with a declared schema, NaN text as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle import schemas
from wattle.sources.readers import read_csv


def load_readings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.READINGS, add_row_id="row_id")


def load_scoring_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SCORING_ROWS)


def load_buildings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.BUILDINGS)


def load_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.WEATHER)


def load_bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """Positions of readings to drop (one column named ``0``) as ``pos``."""
    return read_csv(spark, path, schemas.BAD_ROWS).select(F.col("`0`").alias("pos"))


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TRUTH)
