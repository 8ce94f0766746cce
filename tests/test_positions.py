"""Positions, ranks and streamed group folds; registered values are the tables' values."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.operators import folds, model, score
from wattle.operators.aggregate import quantiles
from wattle.plans import catalog
from wattle.sources import readers
from wattle.sources.positions import range_rank

SF = "/root/testdata/sf0.001"


def test_row_id_is_the_file_position_over_several_and_split_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(10)))
    (tmp_path / "b.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(10, 3010)))
    (tmp_path / "c.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(3010, 3015)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "3000"):                     # packed together; b.csv in several splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = readers.read_csv(spark, str(tmp_path), T.StructType([T.StructField("v", T.IntegerType())]), "row_id")
            assert sorted((r.row_id, r.v) for r in df.collect()) == [(i, i) for i in range(3015)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_range_rank(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), i) for i in r.sample(range(10_000), 700)]
    got = range_rank(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k", "v"], partitions=6).collect()
    assert [(x.k, x.v) for x in sorted(got, key=lambda x: x.pos)] == sorted(rows)
    assert sorted(x.pos for x in got) == list(range(700))


def test_quantiles_of_one_huge_group_with_ties_and_nulls(spark):
    r = random.Random(2)
    rows = [("hot", r.choice([1.0, 2.0, r.uniform(0, 9)])) for _ in range(3000)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 3.0), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {x.k: (x.q30, x.q80) for x in quantiles(df, ["k"], "x", (0.3, 0.8)).collect()}
    want = {x.k: (x.a, x.b) for x in df.groupBy("k").agg(F.percentile("x", 0.3).alias("a"), F.percentile("x", 0.8).alias("b")).collect()}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert got[k] == (None, None) if a is None else got[k] == pytest.approx((a, b), abs=1e-12)


def test_group_folds_are_streamed_in_batches(spark):
    r = random.Random(3)
    rows = [(g, i) for i, g in enumerate(r.choices(range(200), weights=range(1, 201), k=4000))]
    df = spark.createDataFrame(rows, "g long, i long")
    one = {x.g: x.fold for x in folds.group_fold_table(df, 4, "g").collect()}
    assert one == {x.g: x.fold for x in folds.group_fold_table(df, 4, "g", batch=7).collect()}
    sizes = {}
    for g, _ in rows:
        sizes[g] = sizes.get(g, 0) + 1
    load = [0] * 4
    for g in sorted(sizes, key=lambda g: (-sizes[g], -g)):
        f = min(range(4), key=lambda i: (load[i], i))
        load[f] += sizes[g]
        assert one[g] == f


def test_input_columns_pass_through_unaltered(spark):
    acct = {r.c_custkey: r.c_acctbal for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    exempt = catalog.registered()["unit_convert"](spark, SF).filter("site_id <> 1").collect()
    assert exempt and all(r.square_feet == acct[r.building_id] for r in exempt)


def test_inner_join_loses_rows(spark):
    assert 0 < catalog.QUERIES["join_inner"](spark, SF).count() < catalog.QUERIES["scan_readings"](spark, SF).count()


def test_segmented_predictor_equals_one_run_for_each_segment(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.choice("xy"), r.randrange(5), r.random(), i % 3) for i in range(300)],
                               "row_id long, m string, b int, y double, fold int")
    both = {x.row_id: x.oof for x in score.oof_group_mean(df, ["b"], "y", segment="m").collect()}
    for m in "xy":
        for x in score.oof_group_mean(df.filter(F.col("m") == m), ["b"], "y").collect():
            assert both[x.row_id] == pytest.approx(x.oof)


def test_fold_models_score_beats_the_mean_and_repeats(spark):
    r = random.Random(5)
    rows = [(i, float(x), c, 2.0 * x + (5.0 if c == 1 else 0.0) + r.gauss(0, 0.1), i % 3) for i, (x, c) in enumerate((r.random() * 4, r.randrange(3)) for _ in range(600))]
    rows.append((999, 1.0, 1, None, 0))
    df = spark.createDataFrame(rows, "row_id long, x double, c int, y double, fold int")
    params = model.GBTParams(max_iter=15, max_depth=4, step_size=0.3, max_bins=32, min_instances_per_node=5)
    out, models = model.oof_predict(df, ["x", "c"], "y", params=params, categories={"c": 3})
    known = [x for x in out.collect() if x.y is not None]
    mean = sum(x.y for x in known) / len(known)
    assert sum((x.y - x.oof) ** 2 for x in known) < 0.2 * sum((x.y - mean) ** 2 for x in known)
    new = spark.createDataFrame([(1, 2.0, 1), (2, None, None), (3, 0.1, 7)], "row_id long, x double, c int")
    for log_space in (False, True):
        got = sorted(tuple(x) for x in model.score_ensemble(models, new, ["x", "c"], "p", log_space, {"c": 3}).collect())
        assert len(got) == 3 and all(v[-1] >= 0 for v in got)
        assert got == sorted(tuple(x) for x in model.score_ensemble(models, new, ["x", "c"], "p", log_space, {"c": 3}).collect())
