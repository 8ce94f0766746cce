import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattle.operators import encode, folds, score
from wattle.sources.positions import dense_position


def test_kfold_golden(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "row_id long")
    out = folds.folds_kfold(df, 3).orderBy("row_id")
    assert [r.fold for r in out.collect()] == [0, 0, 0, 1, 1, 2, 2]


def test_dense_position_small_ranges(spark):
    keys = random.Random(2).sample(range(10_000), 300)
    df = spark.createDataFrame([(k,) for k in keys], "row_id long")
    out = {r.row_id: r.pos for r in dense_position(df, "row_id", width=37).collect()}
    assert [out[k] for k in sorted(keys)] == list(range(300))


def test_stratified_folds_contiguous_per_class(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, c string")
    out = folds.folds_stratified(df, 4, "c").toPandas().sort_values("row_id")
    for c, g in out.groupby("c"):
        n = len(g)
        fold = g["fold"].tolist()
        assert fold == sorted(fold)
        sizes = g["fold"].value_counts().sort_index().tolist()
        q, r = divmod(n, 4)
        assert sizes == [q + 1] * r + [q] * (4 - r)


def _greedy(sizes: dict, k: int) -> dict:
    order = sorted(sizes, key=lambda g: (-sizes[g], -g))
    load, out = [0] * k, {}
    for g in order:
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += sizes[g]
        out[g] = f
    return out


def test_group_folds_greedy(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, g int")
    got = {r.g: r.fold for r in folds.folds_group(df, 3, "g").select("g", "fold").distinct().collect()}
    sizes = pd.Series([g for _, g in rows]).value_counts().to_dict()
    assert got == _greedy(sizes, 3)
    assert folds.folds_group(df, 3, "g").count() == 300


def test_target_encoding_edges(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("c", 2.0), ("c", 2.0), ("c", 5.0)],
                                  "k string, y double")
    test = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    out = {r.k: r.k_te for r in encode.target_encode(train, "k", "y", apply_to=test).collect()}
    prior = 23.0 / 6
    assert out["b"] == pytest.approx(prior)          # a key seen once -> prior
    assert out["z"] == pytest.approx(prior)          # unseen key -> prior
    import math
    s = 1 / (1 + math.exp(-(2 - 1)))
    assert out["a"] == pytest.approx(prior * (1 - s) + 2.0 * s)


def test_target_encoding_oof_equals_refit(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice("abcde"), rnd.uniform(0, 5), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, k string, y double, fold int")
    got = {r.row_id: r.k_te for r in encode.target_encode_oof(df, "k", "y", "fold").collect()}
    for f in range(3):
        tr = df.filter(F.col("fold") != f)
        te = df.filter(F.col("fold") == f)
        ref = {r.row_id: r.k_te for r in encode.target_encode(tr, "k", "y", apply_to=te).collect()}
        for rid, v in ref.items():
            assert got[rid] == pytest.approx(v, rel=1e-12)


def test_label_encoding_sorted(spark):
    df = spark.createDataFrame([("office",), ("education",), ("office",), ("retail",)], "u string")
    assert sorted({(r[0], r[1]) for r in encode.label_encode(df, "u", replace=False).collect()}) == \
        [("education", 0), ("office", 1), ("retail", 2)]


def test_oof_group_mean_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 4), rnd.uniform(0, 3), rnd.randint(0, 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, g int, y double, fold int")
    got = {r.row_id: r.oof for r in score.oof_group_mean(df, ["g"], "y", "fold").collect()}
    for rid, g, _, f in rows:
        other = [y for _, gg, y, ff in rows if ff != f and gg == g]
        allo = [y for _, _, y, ff in rows if ff != f]
        exp = sum(other) / len(other) if other else sum(allo) / len(allo)
        assert got[rid] == pytest.approx(exp, rel=1e-12)


def test_scores(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, "a"), (1, 3.0, 3.0, "a"), (2, 5.0, None, "b")],
                               "fold int, y double, p double, s string")
    r = score.rmse(df, "y", "p").collect()[0]
    assert r.rmse == pytest.approx((1 / 2) ** 0.5) and r.n_scored == 2 and r.n_unmatched == 1
    m = score.cv_mean_score(df.filter("p is not null"), "y", "p").collect()[0]
    assert m.cv_mean_rmse == pytest.approx(0.5)
    e = score.ensemble_log_space(df.fillna(0.0), ["y", "p"]).collect()
    assert e[0].meter_reading == pytest.approx(2.718281828459045 ** 1.5 - 1)
    e2 = score.ensemble_raw_space(df.fillna(0.0), ["y", "p"]).collect()
    assert e2[0].meter_reading == pytest.approx(((2.718281828459045 - 1) + (2.718281828459045 ** 2 - 1)) / 2)
