from pyspark.sql import functions as F

from golden_helpers import ts
from wattle.operators import clean, joins, setops


def test_outlier_rule_keeps_null_building(spark):
    df = spark.createDataFrame([(None, 0, ts("2016-01-01 00:00:00")), (5, 0, ts("2016-01-01 00:00:00")),
                                (5, 1, ts("2016-01-01 00:00:00"))],
                               "building_id int, meter int, timestamp timestamp_ntz")
    out = clean.drop_startup_outliers(df, 104, 0, "2016-05-21")
    assert out.count() == 2
    assert out.filter(F.col("building_id").isNull()).count() == 1


def test_cutoff_text_rules(spark):
    df = spark.createDataFrame([(1, 0, ts("2016-05-20 00:00:00")), (2, 0, ts("2016-05-19 23:00:00"))],
                               "building_id int, meter int, timestamp timestamp_ntz")
    # text rule  <= "2016-05-20": only timestamps before 2016-05-20 00:00:00 match -> that row is kept
    kept = clean.drop_startup_outliers(df, 104, 0, "2016-05-20 00:00:00", inclusive=False)
    assert [r.building_id for r in kept.collect()] == [1]
    # text rule  < "2016-05-21": all of 05-20 matches -> dropped
    assert clean.drop_startup_outliers(df, 104, 0, "2016-05-21 00:00:00").count() == 0


def test_exclude_entity_keeps_null(spark):
    df = spark.createDataFrame([(None,), (245,), (1,)], "building_id int")
    assert sorted(r.building_id or -1 for r in clean.exclude_entity(df, "building_id", 245).collect()) == [-1, 1]


def test_drop_bad_rows_by_position(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "row_id long, v double")
    bad = spark.createDataFrame([(2,), (5,), (5,)], "pos long")
    assert sorted(r.row_id for r in clean.drop_bad_rows(df, bad).collect()) == [0, 1, 3, 4, 6, 7, 8, 9]


def test_year_range_is_pushed_down(spark, tmp_path):
    import datetime as dt
    p = str(tmp_path / "t")
    spark.createDataFrame([(i, dt.datetime(2015 + i % 5, 1, 1)) for i in range(20)], "i int, t timestamp_ntz") \
        .write.parquet(p)
    out = clean.year_range(spark.read.parquet(p), "t", 2017, 2018)
    assert out.count() == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(t" in plan


def test_left_join_toy(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "name string, score double")
    out = joins.join_dimension(names, scores, "name")
    assert out.count() == 4 and out.filter(F.col("score").isNull()).count() == 1


def test_union_by_name_fills_missing(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2,)], "k int")
    out = setops.union_by_name(a, b).orderBy("k").collect()
    assert out[1].v is None
    assert setops.set_difference(a.unionByName(b.withColumn("v", F.lit(1.0))), a, ["k"]).count() == 1
