"""Facts stored in buckets, sorted by their join key: joins and aggregates on that key
read the buckets side by side and shuffle nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from wattle.session import scratch_path


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "facts") -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``keys``, sorted within them, in the
    shared folder.  The rows are shuffled once, here, so that a bucket is one file; a
    bucket should fit a task (choose ``buckets`` by the size of the input, the same for
    tables that are to be joined).  Rows with a null key are kept, in one bucket."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
     .option("path", scratch_path(spark, table)).format("parquet").saveAsTable(table))
    return spark.table(table)
