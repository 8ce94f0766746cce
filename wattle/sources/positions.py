"""Row positions without a one-task window.

Constructions that replace pandas' implicit row index:

``with_row_id``     file position of each row of a scan: files in path order, the
                    splits of a file by their offset, rows by their place in the
                    split.  Only the table of splits is summed up in order.
``dense_position``  0..n-1 rank of rows by a unique integer key (pandas
                    ``reset_index(drop=True)`` after a filter), optionally
                    restarted per class.  Rows are cut into key ranges of
                    ``width`` keys; each range holds at most ``width`` rows, so
                    the per-range ``row_number`` window is bounded no matter
                    how the data is skewed.  Only the per-range count table
                    goes through a prefix-sum window.
``range_rank``      0..n-1 rank of distinct rows by any columns: rows are dealt to
                    range partitions (from sampled bounds), ranked in their
                    partition and shifted by the counts of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattle.session import write_table

#: keys of a range, each of which is ranked by one task
DEFAULT_WIDTH = 1 << 17


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Append the 0-based file position of each row.

    Must be applied directly on a file scan (its ``_metadata`` names the file and
    the split; no shuffle in between, so the ids are the same in both branches).
    """
    mid = "__wattle_mid"
    tagged = df.select("*", F.monotonically_increasing_id().alias(mid), F.col("_metadata.file_path").alias("__path"),
                       F.col("_metadata.file_block_start").alias("__start"))
    splits = tagged.groupBy("__path", "__start").agg(F.min(mid).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__path", "__start", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # one row per file split
    joined = tagged.join(splits, ["__path", "__start"], "inner")
    return joined.select(*[F.col(c) for c in df.columns],
                         (F.col("__off") + F.col(mid) - F.col("__first")).cast("long").alias(name))


def range_rank(df: DataFrame, cols: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Append the 0-based rank of each row by ``cols`` (NULLs first); rows must be
    distinct in ``cols``.  The dealt rows are written once, so that both uses of
    the partition number see the same bounds."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = "__wattle_part"
    dealt = write_table(df.repartitionByRange(n, *cols).withColumn(part, F.spark_partition_id()), "range-rank")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*cols)) - 1
    # one row per partition: bounded by the partition count
    return (dealt.withColumn("__lpos", local).join(F.broadcast(offsets), part)
            .select(*df.columns, (F.col("__off") + F.col("__lpos")).cast("long").alias(name)))


def dense_position(df: DataFrame, key: str, name: str = "pos", by: list[str] | None = None,
                   width: int = DEFAULT_WIDTH, total: str | None = None) -> DataFrame:
    """0..n-1 position of each row ordered by the unique integer ``key``
    (restarting per ``by`` group when given).  ``total`` adds the group's row
    count, taken from the same per-range count table (no extra job)."""
    by = list(by or [])
    rng = "__wattle_rng"
    ranged = df.withColumn(rng, F.floor(F.col(key) / F.lit(width)).cast("long"))
    w_local = Window.partitionBy(*by, rng).orderBy(key)
    local = ranged.withColumn("__lpos", F.row_number().over(w_local) - 1)
    # counts from the same windowed rows: both branches share one shuffle of the input
    counts = local.groupBy(*by, rng).agg(F.count(F.lit(1)).alias("__n"))
    w_pref = Window.partitionBy(*by).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("__n").over(Window.partitionBy(*by)).alias("__total")] if total else []
    offsets = counts.select(*by, rng, F.coalesce(F.sum("__n").over(w_pref), F.lit(0)).alias("__off"),
                            *extra)
    # one row per (group, key range): no hint, sparse keys may make many ranges
    out = local.join(offsets, by + [rng], "inner")
    tail = [F.col("__total").cast("long").alias(total)] if total else []
    return out.select(*[F.col(c) for c in df.columns],
                      (F.col("__off") + F.col("__lpos")).cast("long").alias(name), *tail)

