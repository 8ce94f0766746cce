"""Explicit schemas of the domain tables (no inference on ingest)."""

from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("building_id", T.IntegerType()),
    T.StructField("meter", T.IntegerType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("meter_reading", T.DoubleType()),
])

SCORING_ROWS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("building_id", T.IntegerType()),
    T.StructField("meter", T.IntegerType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

BUILDINGS = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("building_id", T.IntegerType()),
    T.StructField("primary_use", T.StringType()),
    T.StructField("square_feet", T.DoubleType()),
    T.StructField("year_built", T.IntegerType()),
    T.StructField("floor_count", T.DoubleType()),
])

WEATHER_COLUMNS = ["air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
                   "sea_level_pressure", "wind_direction", "wind_speed"]

WEATHER = T.StructType(
    [T.StructField("site_id", T.IntegerType()), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_COLUMNS])

BAD_ROWS = T.StructType([T.StructField("0", T.LongType())])

TRUTH = T.StructType([
    T.StructField("building_id", T.IntegerType()),
    T.StructField("meter", T.IntegerType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("meter_reading", T.DoubleType()),
])

TEMPLATE = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("meter_reading", T.DoubleType()),
])
