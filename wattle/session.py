"""Session helpers: configuration, the shared checkpoint folder, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast policy.  Tables that are small by construction (one row per fold,
# per input partition, per nation) get an explicit ``F.broadcast`` hint.  Every
# side whose size depends on the data is joined without a hint; adaptive query
# execution measures it at run time and broadcasts it only below
# ``spark.sql.adaptive.autoBroadcastJoinThreshold`` (set here), else keeps the
# shuffle join.
AQE_BROADCAST_BYTES = str(64 * 1024 * 1024)


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wattle", driver_memory: str | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    On a cluster ``master`` stays None and the launcher decides; locally pass
    ``local[N]``.  The Spark UI is left off: no extra ports.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.autoBroadcastJoinThreshold", AQE_BROADCAST_BYTES)
         .config("spark.sql.autoBroadcastJoinThreshold", AQE_BROADCAST_BYTES)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:          # local mode: the driver JVM is the only executor
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir).  Where neither is set, a machine-local folder is made for
    a single-machine session only; a cluster session is an error, because its
    executors would not see that folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="wattle-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-path of the shared folder for a written table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the
    shared folder (survives executor loss; never a local checkpoint).  Meant
    for small derived tables reused by several branches of a plan and for
    model-training inputs read many times."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under a new path in the shared folder and read it
    back.  Cuts lineage like a checkpoint and, unlike one, gives the planner
    the table's real on-disk size: a small derived dimension is then
    broadcast by the planner's own size check
    (``spark.sql.autoBroadcastJoinThreshold``) and a large one is not.
    ``rows_per_file`` bounds the files, for tables read by long tasks: a small file of
    many rows is one partition to its readers, whatever the cores."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file or 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path)     # known schema: no footer-inference job


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table of this session's shared folder whose successor has been written."""
    if not path.startswith(shared_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once an application), whose Python workers import it."""
    root = os.path.dirname(os.path.abspath(__file__))
    app = spark.sparkContext.applicationId
    if app in _shipped or not os.path.isdir(root):              # already inside an archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="wattle-package-"), "wattle_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)                          # served from the driver
    _shipped.add(app)


def size_for_input(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Size shuffles and scan splits for the data actually read.

    Initial shuffle partitions = input bytes / target partition bytes
    (AQE then coalesces small ones toward the advisory size and splits
    skewed ones); scan splits use the same target.  Returns the settings
    applied.  On 100 TB with 256 MB partitions this is ~400k; pass a larger
    target size for fewer partitions.
    """
    n = max(1, -(-int(input_bytes) // int(partition_bytes)))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths``: the ``binaryFile`` source's
    ``length`` column comes from the file listing (the unselected ``content``
    column is pruned, so no file is read)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .load(paths).select(F.sum("length").alias("n")))
    return int(df.first()["n"] or 0)
