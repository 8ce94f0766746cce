import os
import random
import struct

import pandas as pd
from pyspark.sql import functions as F

from wattle import schemas
from wattle.session import scratch_path
from wattle.sources import readers, sinks


def test_csv_row_id_is_file_position(spark, tmp_path):
    n = 5000
    pdf = pd.DataFrame({"building_id": range(n), "meter": [i % 4 for i in range(n)],
                        "timestamp": pd.date_range("2016-01-01", periods=n, freq="h").strftime("%Y-%m-%d %H:%M:%S"),
                        "meter_reading": [float(i) / 7 for i in range(n)]})
    pdf.loc[3, "meter_reading"] = float("nan")
    p = str(tmp_path / "train.csv")
    pdf.to_csv(p, index=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = readers.read_csv(spark, p, schemas.READINGS, add_row_id="row_id")
        assert df.rdd.getNumPartitions() > 3
        rows = df.select("row_id", "building_id", "meter_reading").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.row_id == r.building_id for r in rows)
    assert [r for r in rows if r.building_id == 3][0].meter_reading is None


def test_fixed_decimals_round_binary_values(spark):
    df = spark.createDataFrame([(0, 0.03125), (1, 2.675), (2, None)], "i int, v double")
    out = sinks.format_fixed(df, ["v"], 4).orderBy("i").collect()
    assert [r.v for r in out] == ["0.0312", "2.6750", None]
    out2 = sinks.format_fixed(df, ["v"], 2).orderBy("i").collect()
    assert out2[1].v == "2.67"                      # exact binary value is 2.67499999...


def test_fixed_decimals_equal_printf(spark):
    """Random doubles of every size, all ties of the fourth place in a range, and edges."""
    r = random.Random(12)
    vals = [r.choice([-1, 1]) * r.random() * 10.0 ** r.randint(-12, 30) for _ in range(100_000)]
    vals += [struct.unpack("d", r.randbytes(8))[0] for _ in range(100_000)]
    vals += [sign * k / 32 for k in range(20_000) for sign in (1, -1)]                # 1/32 = 0.03125
    vals += [0.0, -0.0, -0.00001, 0.99995, 9.99995, 5e-324, 2.0**62, 2.0**63, 2.0**124, 1e16 + 2, float("inf"), float("-inf")]
    vals = [v for v in vals if v == v and (abs(v) < 2.0**125 or abs(v) == float("inf"))]
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    for decimals in (4, 1, 9):
        out = df.select("v", sinks.fixed_text(F.col("v"), decimals).alias("t"))
        assert [x for x in out.toPandas().itertuples(index=False) if x.t != f"{x.v:.{decimals}f}"] == []
    assert "Python" not in out._jdf.queryExecution().toString()


def test_segments_round_trip_and_template(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "row_id long, meter int, v double")
    path = sinks.write_segments(df, scratch_path(spark, "seg-test"), "meter")
    names = os.listdir(path.replace("file:", ""))
    assert {"meter=0", "meter=1", "meter=2"} <= set(names)
    back = sinks.read_segments(spark, path)
    assert back.count() == 30
    assert sinks.read_segments(spark, path, segment="meter", value=2).count() == 10
    template = spark.createDataFrame([(i,) for i in range(35)], "row_id long")
    aligned = sinks.align_to_template(template, df.withColumnRenamed("v", "meter_reading"))
    assert aligned.count() == 35 and aligned.filter(F.col("meter_reading").isNull()).count() == 5


def test_shape_and_limit(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "row_id long, v double")
    assert readers.shape(df).collect()[0].asDict() == {"n_rows": 10, "n_cols": 2}
    assert [r.row_id for r in readers.scan_limit(df, 3).collect()] == [0, 1, 2]


def test_narrow_schema_strict_bounds(spark):
    from wattle.operators.project import narrow_schema, range_report
    df = spark.createDataFrame([(1, 127, 1.5), (2, -5, 2.5)], "a long, b long, c double")
    rep = {r.column_name: r.target_type for r in range_report(df).collect()}
    assert rep == {"a": "tinyint", "b": "smallint", "c": "float"}     # 127 does not fit int8
    assert dict(narrow_schema(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "float"}


def test_size_for_input(spark):
    from wattle.session import input_bytes, size_for_input
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
                                             "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        n = input_bytes(spark, ["/root/testdata/sf0.01/events.parquet"])
        assert n > 0
        conf = size_for_input(spark, 100 * 1024 ** 4)            # 100 TB
        assert conf["spark.sql.shuffle.partitions"] == "409600"
        conf = size_for_input(spark, 10 * 1024 ** 3)             # 10 GB -> 40 x 256 MB
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
