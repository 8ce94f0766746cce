"""Spark-side helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import wattle
from wattle.session import scratch_path

#: rows in one Arrow batch; with long texts the byte bound below ends a batch earlier
ARROW_ROWS = 512
ARROW_BYTES = 4 * 1024 * 1024


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send the package to the executors, whose Python workers import it: ``addPyFile``
    serves the archive from the driver, so no folder needs to be shared for it."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(wattle.__file__))
    if sc.applicationId in _shipped or not os.path.isdir(root):   # already inside an archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="wattle-code-"), "wattle_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def tune(spark: SparkSession) -> None:
    """Ready the session for Python workers: the package is there, and Arrow batches
    are bounded (texts may be long)."""
    _ship(spark)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        try:
            if int(spark.conf.get(key, None) or 0) != value:
                spark.conf.set(key, str(value))
        except Exception as e:  # a setting that this Spark version does not have
            if "CONFIG" not in str(e).upper():
                raise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text as UTF-8 bytes, null text as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not occur in ``df`` (case-insensitively), made from ``names``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def quoted(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of ``df`` by name, safe for names with dots or backticks."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (names or df.columns)]


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, so a
    lost executor costs a re-read, not the whole chain."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)          # texts: a third less disk than by default
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, size: int, *cols: str) -> DataFrame:
    """``size`` rows of ``df`` (all if it has fewer), the first by the hash of ``cols``.
    Rows that cannot be among them by far are dropped before the sort, so that what
    reaches the one task that ends it does not grow with the table."""
    n = df.count()
    h = F.xxhash64(*cols)
    bits = 40
    if n > 4 * size:
        df = df.filter(F.shiftrightunsigned(h, 64 - bits) < F.lit(int(4 * size / n * 2**bits)))
    return df.orderBy(h, *cols).limit(size)


def sorted_digest(items: Column) -> Column:
    """Hex sha-256 of the comma-joined string array."""
    return F.sha2(F.array_join(items, ","), 256)
