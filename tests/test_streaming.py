from pyspark.sql import functions as F

from wattle.session import scratch_path
from wattle.streaming import score_micro_batches


def test_micro_batch_scoring(spark):
    src = scratch_path(spark, "stream-src")
    spark.createDataFrame([(i, float(i)) for i in range(20)], "row_id long, x double").write.parquet(src)
    stream = spark.readStream.schema("row_id long, x double").parquet(src)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    q = score_micro_batches(stream, lambda b: b.withColumn("pred", F.col("x") * 2), out, ck)
    q.processAllAvailable()
    q.stop()
    res = spark.read.parquet(out)
    assert res.count() == 20 and res.filter(F.col("pred") != F.col("x") * 2).count() == 0
