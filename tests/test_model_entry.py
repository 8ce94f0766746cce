import math

from pyspark.sql import functions as F

import __spark_entry__ as E
from wattle.operators import model
from wattle.plans import catalog
from wattle.sources.positions import dense_position


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"row_id", "meter_reading", "air_temperature", "feels_like", "is_holiday"} <= set(df.columns)
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert (set(q) - set(o)) & set(catalog.QUERIES) == E.NO_ORACLE


def test_gbt_oof_and_importance(spark):
    rows = [(i, i % 3, float(i % 10), float((i * 7) % 13), float(i % 10) * 2 + (i % 13) * 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, fold int, a double, b double, y double")
    params = model.GBTParams(max_iter=10, max_depth=3, min_instances_per_node=2, max_bins=16,
                             subsampling_rate=1.0, feature_subset="all", step_size=0.3)
    oof, models = model.oof_predict(df, ["a", "b"], "y", "fold", params)
    assert len(models) == 3
    assert oof.count() == 300 and oof.select("row_id").distinct().count() == 300
    err = oof.select(F.sqrt(F.avg(F.pow(F.col("y") - F.col("oof"), 2)))).first()[0]
    base = df.select(F.stddev_pop("y")).first()[0]
    assert math.isfinite(err) and err < base
    imp = model.feature_importance(models[0], ["a", "b"]).collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-9


def test_left_joins_keep_rows(spark):
    from wattle.sources import driver_tables as dt
    d = "/root/testdata/sf0.001"
    kept = catalog.QUERIES["drop_bad_rows"](spark, d).count()
    assert catalog.QUERIES["training_frame"](spark, d).count() == kept
    assert catalog.QUERIES["scoring_frame"](spark, d).count() == dt.readings(spark, d).count()
    assert catalog.QUERIES["join_weather"](spark, d).count() == dt.readings(spark, d).count()


def test_model_frame_is_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FRAME_ROWS", 100, raising=False)
    frame, _ = catalog._model_frame(spark, "/root/testdata/sf0.001")
    files = frame.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) <= 100


def test_dense_position_ranks_in_more_than_one_task(spark):
    n = 1 << 20
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = dense_position(spark.range(n).toDF("k"), "k", total="n").withColumn("part", F.spark_partition_id())
        row = out.agg(F.count_distinct("part").alias("parts"), F.sum((F.col("pos") != F.col("k")).cast("int")).alias("wrong"),
                      F.max("n").alias("n"), F.count("*").alias("rows")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert row["parts"] > 1 and row["wrong"] == 0 and row["n"] == row["rows"] == n


def test_param_search_fits_points_by_folds_alone(spark, monkeypatch):
    """As many folds as there are, a fit for each with each point and none beside them; the
    errors are those of fits made by hand."""
    rows = [(i, i % 4, float(i % 10), float((i * 7) % 13), float(i % 10) * 2 + (i % 13) * 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, fold int, a double, b double, y double").coalesce(1)
    base = model.GBTParams(max_iter=2, max_depth=2, min_instances_per_node=2, max_bins=16, subsampling_rate=1.0, feature_subset="all")
    monkeypatch.setattr(model, "sample_params", lambda n, seed: [{"maxDepth": 1, "featureSubsetStrategy": "all", "subsamplingRate": 1.0,
                                                                  "minInstancesPerNode": 2}][:n])
    fits, fit = [], model.GBTRegressor._fit
    monkeypatch.setattr(model.GBTRegressor, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    got = {r.point: r.avg_rmse for r in model.param_search(df, ["a", "b"], "y", "fold", n_points=2, base=base).collect()}
    assert len(fits) == 2 * 4
    data = model.assemble_features(df, ["a", "b"])
    for point, depth in ((0, 2), (1, 1)):
        errors = []
        for k in range(4):
            est = model.GBTParams(max_iter=2, max_depth=depth, min_instances_per_node=2, max_bins=16, subsampling_rate=1.0,
                                  feature_subset="all").estimator("features", "y")
            scored = est.fit(data.filter(F.col("fold") != k)).transform(data.filter(F.col("fold") == k))
            errors.append(scored.select(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0])
        assert math.isclose(got[point], sum(errors) / 4, rel_tol=1e-9)
