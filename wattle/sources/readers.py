"""Scans: CSV with explicit schemas, row-limited smoke scans, shape previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.sources.positions import with_row_id


def read_csv(spark: SparkSession, path: str, schema: T.StructType, add_row_id: str | None = None,
             timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Header CSV with a declared schema; NaN text becomes NULL.

    ``add_row_id`` appends the file position (what pandas' default index is),
    needed when a later step addresses rows by position.
    """
    df = (spark.read.schema(schema)
          .option("header", True)
          .option("timestampNTZFormat", timestamp_format)
          .option("timestampFormat", timestamp_format)
          .option("nanValue", "NaN")
          .option("mode", "FAILFAST")
          .csv(path))
    df = nan_to_null(df)
    return with_row_id(df, add_row_id) if add_row_id else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in floating columns: Spark's avg/max propagate NaN where
    pandas skips it."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def scan_limit(df: DataFrame, n: int, order_by: str = "row_id") -> DataFrame:
    """First ``n`` rows in file order (the smoke-run mode): a top-n, not a sample."""
    return df.orderBy(order_by).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols) as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"))
