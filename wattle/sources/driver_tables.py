"""Adapters that map the driver's parquet tables onto the reference's star.

| Role      | Derivation                                                                 |
|-----------|----------------------------------------------------------------------------|
| readings  | ``events`` summed per (user_id, event_type, hour): building_id = user_id, |
|           | meter = event_type, timestamp = hour, meter_reading = sum(value) (exact), |
|           | row_id = smallest event_id of the hour (file position of its first row)   |
| weather   | returned ``lineitem`` rows per (site, hour of January 2024), nothing of   |
|           | the readings: site_id = orderkey mod 25, hour from part, line and order;  |
|           | air = avg(quantity) - 10, dew = min(quantity) - 12, cloud =               |
|           | stddev_samp(quantity)/2, precip = max - min quantity, pressure =          |
|           | max(extendedprice), wind direction = avg(partkey mod 360), speed = count  |
| buildings | ``customer`` + ``nation``: building_id = c_custkey, site_id = c_nationkey, |
|           | primary_use = c_mktsegment, square_feet = c_acctbal,                       |
|           | floor_count = n_regionkey (0 occurs: exercises the zero-floor rule)        |
| bad rows  | positions (event_id) of raw events with value < 1 (near-zero readings)    |
| calendar  | ``orders.o_orderdate`` spans 1995-2001 (multi-year calendar rules)        |
| order     | ``orders`` as readings of several years: building = o_custkey, meter =    |
| readings  | o_orderpriority, timestamp = o_orderdate, meter_reading = o_totalprice/1000 |

All timestamps stay ``timestamp_ntz``; the hour is built with
``make_timestamp_ntz`` so no session time zone is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hour_of(ts: str | Column) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("building_id"),
                       F.col("event_type").alias("meter"),
                       hour_of("ts").alias("timestamp"))
            .agg(F.min("event_id").alias("row_id"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("meter_reading"))
            .select("row_id", "building_id", "meter", "timestamp", "meter_reading"))


def scoring_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to predict: the reading keys without the target."""
    return readings(spark, sf_dir).drop("meter_reading")


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    h = F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber") * 131 + F.col("l_orderkey"), F.lit(720))
    hour = F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.floor(h / 24) + 1).cast("int"), (h % 24).cast("int"), F.lit(0), F.lit(0))
    q = F.col("l_quantity")
    return (li.groupBy(F.pmod(F.col("l_orderkey"), F.lit(25)).alias("site_id"), hour.alias("timestamp"))
            .agg((F.avg(q) - 10).alias("air_temperature"),
                 (F.stddev_samp(q) / 2).alias("cloud_coverage"),
                 (F.min(q) - 12).alias("dew_temperature"),
                 (F.max(q) - F.min(q)).alias("precip_depth_1_hr"),
                 F.max("l_extendedprice").alias("sea_level_pressure"),
                 F.avg(F.col("l_partkey") % 360).alias("wind_direction"),
                 F.count(F.lit(1)).cast("double").alias("wind_speed")))


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("building_id"), F.col("o_orderpriority").alias("meter"),
                    F.col("o_orderdate").alias("timestamp"), (F.col("o_totalprice") / 1000).alias("meter_reading"))


def raw_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = load(spark, sf_dir, "customer")
    nat = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = cust.join(F.broadcast(nat), cust.c_nationkey == nat.n_nationkey, "left")  # 25 nations
    return j.select(F.col("c_nationkey").alias("site_id"),
                    F.col("c_custkey").alias("building_id"),
                    F.col("c_mktsegment").alias("primary_use"),
                    F.col("c_acctbal").alias("square_feet"),
                    F.col("n_regionkey").cast("double").alias("floor_count"))


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.filter(F.col("value") < 1).select(F.col("event_id").alias("pos"))


def calendar_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("timestamp"),
                    F.col("o_totalprice").alias("value"))
