"""Leaf-wise fleet against brute force, single fits, the library's depth-wise trees, and
the guided search."""

from __future__ import annotations

import math
import random
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattle.operators import flat_trees, leafwise, model, search
from wattle.operators.binning import fit_bins
from wattle.operators.leafwise import LeafwiseParams, train_fleet
from wattle.session import scratch_path, write_table

PLAIN = LeafwiseParams(num_leaves=6, learning_rate=0.5, n_rounds=3, lambda_l2=0.7, min_data_in_leaf=2, feature_fraction=1.0, bagging_fraction=1.0)


def best_first(x, y, p):
    """One boosted model on one numeric feature, split by split, as predictions."""
    f = np.full(len(y), y.mean())
    for _ in range(p.n_rounds):
        g, leaves = f - y, [np.arange(len(y))]

        def best(rows, g=g):
            top = (1e-12, None)
            for t in np.unique(x[rows])[:-1]:
                lo, hi = rows[x[rows] <= t], rows[x[rows] > t]
                if min(len(lo), len(hi)) >= p.min_data_in_leaf:
                    gain = sum(s * g[r].sum() ** 2 / (len(r) + p.lambda_l2) for s, r in ((1, lo), (1, hi), (-1, rows)))
                    if gain > top[0] + 1e-9:
                        top = (gain, (lo, hi))
            return top
        while len(leaves) < p.num_leaves:
            found = [best(r) for r in leaves]
            i = max(range(len(leaves)), key=lambda k: found[k][0])
            if found[i][1] is None:
                break
            leaves[i:i + 1] = found[i][1]
        for r in leaves:
            f[r] -= p.learning_rate * g[r].sum() / (len(r) + p.lambda_l2)
    return f


@pytest.mark.parametrize("driver_bytes", [leafwise.DRIVER_BYTES, 0])
def test_one_feature_equals_brute_force(spark, driver_bytes):
    r = np.random.default_rng(4)
    x, noise = np.sort(r.integers(0, 40, 150)).astype(float), r.normal(0, 0.2, 150)
    y = np.sin(x / 4) * x + noise
    df = write_table(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, a double, y double"), "t")
    fleet = train_fleet(df, ["a"], "y", params=PLAIN, driver_bytes=driver_bytes)
    got = np.array([q.prediction for q in fleet.predict(df).orderBy("id").collect()])
    assert np.allclose(got, best_first(x, y, PLAIN), atol=1e-9)


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        a, b, c, s = r.random() * 10, r.choice([None, r.random()]), r.randint(0, 5), r.choice(["p", "q", None])
        y = math.sin(a) + (2 if b is None else b) * 0.5 + (1.5 if c in (1, 4) else 0) + {"p": 0, "q": 1, None: 2}[s] + r.gauss(0, 0.1)
        rows.append((i, s, i % 3, a, b, c, None if i % 97 == 0 else y))
    return write_table(spark.createDataFrame(rows, "id int, seg string, fold int, a double, b double, c int, y double"), "leafwise-data")


SMALL = LeafwiseParams(num_leaves=8, n_rounds=4, learning_rate=0.4, min_data_in_leaf=5, patience=2)
FEATURES, CATS = ["a", "b", "c"], {"c": 6}


def test_fleet_equals_models_one_by_one(spark, data):
    fleet = train_fleet(data, FEATURES, "y", "seg", "fold", SMALL, CATS)
    assert sorted(fleet.models, key=str) == sorted([(s, k, 0) for s in ("p", "q", "") for k in range(3)], key=str)
    alone_rounds = 0
    for s, where in (("p", "seg = 'p'"), ("", "seg IS NULL")):
        own = write_table(data.filter(where), "own")
        alone = train_fleet(own, FEATURES, "y", "seg", "fold", SMALL, CATS, bins=fleet.bins)
        alone_rounds = max(alone_rounds, alone.rounds)
        for k, m in alone.models.items():
            other = fleet.models[k]
            assert np.allclose(m.history, other.history, atol=1e-9) and m.best == other.best
            for t, u in zip(m.trees, other.trees, strict=True):
                assert np.array_equal(t.feature, u.feature) and np.array_equal(t.goes_left, u.goes_left) and np.allclose(t.value, u.value, atol=1e-9)
    assert fleet.rounds <= 2 * alone_rounds                       # jobs do not grow with the models
    in_spark = train_fleet(data, FEATURES, "y", "seg", "fold", LeafwiseParams(num_leaves=5, n_rounds=2), CATS, driver_bytes=0)
    at_driver = train_fleet(data, FEATURES, "y", "seg", "fold", LeafwiseParams(num_leaves=5, n_rounds=2), CATS)
    assert [m.history for m in in_spark.models.values()] == [m.history for m in at_driver.models.values()]


def test_blocks_written_anew_change_nothing(spark, data, monkeypatch):
    p = LeafwiseParams(num_leaves=4, n_rounds=5, min_data_in_leaf=5)
    whole = train_fleet(data, FEATURES, "y", "seg", "fold", p, CATS)
    monkeypatch.setattr(leafwise, "KEEP_TREES", 2)
    again = train_fleet(data, FEATURES, "y", "seg", "fold", p, CATS)
    assert all(np.allclose(m.history, again.models[k].history, atol=1e-9) and len(m.trees) == 5 for k, m in whole.models.items())


def test_out_of_fold_and_ensembles(spark, data):
    fleet = train_fleet(data, FEATURES, "y", "seg", "fold", SMALL, CATS)
    rows = data.orderBy("id").collect()
    codes = fleet.bins.codes([np.array([np.nan if v is None else float(v) for v in (q[f] for q in rows)]) for f in FEATURES])
    raw = {k: m.raw(codes) for k, m in fleet.models.items()}
    oof = [q.oof for q in fleet.out_of_fold(data).orderBy("id").collect()]
    assert np.allclose(oof, [raw[q.seg or "", q.fold, 0][i] for i, q in enumerate(rows)])
    own = [[raw[q.seg or "", k, 0][i] for k in range(3)] for i, q in enumerate(rows)]
    for log_space, want in ((None, np.mean(own, axis=1)), (False, np.expm1(own).mean(axis=1)), (True, np.expm1(np.mean(own, axis=1)))):
        for limit in (flat_trees.BROADCAST_BYTES, 1):              # one pass, and a part per model
            got = [q.p for q in fleet.predict(data, "p", log_space, limit=limit).orderBy("id").collect()]
            assert np.allclose(got, want)
    assert all(q.p >= 0 for q in fleet.predict(data, "p", True, clip=True).collect())
    unseen = data.limit(3).withColumn("seg", F.lit("new"))
    assert [q.p for q in fleet.predict(unseen, "p").collect()] == [None] * 3
    held = np.array([q.y for q in rows], float)
    err = np.sqrt(np.nanmean((held - np.array(oof)) ** 2))
    assert err < np.nanstd(held) * 0.8
    imp = {q.feature: q.importance for q in fleet.importance(spark).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and min(imp.values()) > 0


def test_history_is_the_error_of_the_left_out_fold_and_stops(spark, data):
    long = LeafwiseParams(num_leaves=12, n_rounds=40, learning_rate=1.0, min_data_in_leaf=1, lambda_l2=0.0, patience=3, bagging_fraction=0.5)
    m = train_fleet(data, FEATURES, "y", fold="fold", params=long, categories=CATS).models["", 0, 0]
    assert m.best == int(np.argmin(m.history)) and len(m.trees) < 40 and len(m.history) - 1 - m.best == 3
    rows = data.filter("fold = 0 AND y IS NOT NULL").collect()
    fleet_bins = fit_bins(data.filter("y IS NOT NULL"), FEATURES, CATS)
    codes = fleet_bins.codes([np.array([np.nan if q[f] is None else float(q[f]) for q in rows]) for f in FEATURES])
    assert math.isclose(np.sqrt(np.mean((m.raw(codes) - [q.y for q in rows]) ** 2)), min(m.history), rel_tol=1e-9)


def test_better_than_depth_wise_trees_at_equal_leaves(spark):
    r = np.random.default_rng(3)
    x = r.random((1500, 3))
    y = np.where(x[:, 0] > 0.9, np.sin(x[:, 1] * 40), 0.0) + 0.05 * r.normal(size=1500)     # all structure in one corner
    df = write_table(spark.createDataFrame([(i, i % 2, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                                           "row_id int, fold int, a double, b double, c double, y double"), "corner")
    p = LeafwiseParams(num_leaves=8, n_rounds=6, learning_rate=0.5, min_data_in_leaf=3, feature_fraction=1.0, bagging_fraction=1.0, lambda_l2=0.0)
    fleet = train_fleet(df, ["a", "b", "c"], "y", fold="fold", params=p)
    rmse = lambda d: d.select(F.sqrt(F.avg(F.pow(F.col("y") - F.col("oof"), 2)))).first()[0]
    depth_wise = model.GBTParams(max_iter=6, max_depth=3, step_size=0.5, subsampling_rate=1.0, feature_subset="all", min_instances_per_node=3)
    other, _ = model.oof_predict(df, ["a", "b", "c"], "y", "fold", depth_wise, early_stopping=False)
    assert rmse(fleet.out_of_fold(df)) < rmse(other)


def test_no_rows_and_constant_labels(spark, data):
    empty = train_fleet(data.limit(0), FEATURES, "y", "seg", "fold", SMALL, CATS)
    assert empty.models == {} and [q.p for q in empty.predict(data.limit(2), "p").collect()] == [None, None]
    flat = train_fleet(write_table(data.withColumn("y", F.lit(2.5)), "flat"), FEATURES, "y", fold="fold", params=SMALL, categories=CATS)
    assert {round(q.p, 9) for q in flat.predict(data, "p").collect()} == {2.5}


RANGES = {"num_leaves": (3, 12), "lambda_l2": (0.1, 2.0), "feature_fraction": (0.3, 1.0)}
KNOWN = {"num_leaves": 6, "lambda_l2": 1.0, "feature_fraction": 1.0}


def test_search_goes_on_where_it_broke_off(spark, data):
    base = LeafwiseParams(n_rounds=2, min_data_in_leaf=5)
    go = lambda path, n: search.guided_search(data, FEATURES, "y", "fold", path, base, RANGES, KNOWN, 2, n, categories=CATS)
    a, b = scratch_path(spark, "trials"), scratch_path(spark, "trials")
    whole = go(a, 2).orderBy("trial").collect()
    go(b, 0)
    assert go(b, 2).orderBy("trial").collect() == whole
    assert [q.kind for q in whole] == ["known", "random", "random", "guided", "guided"]
    assert whole[0].num_leaves == 6 and all(q.best_rmse == min(w.rmse for w in whole[:i + 1]) for i, q in enumerate(whole))


def test_proposals_find_the_minimum():
    ranges = {"a": (0.0, 1.0), "b": (-2.0, 2.0), "n": (1, 50)}
    error = lambda p: (p["a"] - 0.3) ** 2 + (p["b"] - 1) ** 2 / 10 + (p["n"] - 20) ** 2 / 5000
    r = np.random.default_rng(1)
    trials = [(p, error(p)) for p in (search.to_point(x, ranges) for x in r.random((6, 3)))]
    start = min(e for _, e in trials)
    while len(trials) < 30:
        p = search.propose(trials, ranges, 1, 7, len(trials))[0]
        assert all(lo <= p[n] <= hi for n, (lo, hi) in ranges.items()) and isinstance(p["n"], int)
        trials.append((p, error(p)))
    guided = min(e for _, e in trials)
    blind = min(error(search.to_point(x, ranges)) for x in r.random((24, 3)))
    assert guided < start / 4 and guided < blind
    assert len({tuple(p.values()) for p in search.propose(trials, ranges, 4, 7, 30)}) == 4


def test_leaf_of_some_rows_either_way(monkeypatch):
    rng = np.random.default_rng(5)
    n = 31                                                      # node i has the children 2 i + 1 and 2 i + 2
    at = np.arange(n, dtype=np.int32)
    inner = at < 15
    tree = flat_trees.Tree(np.where(inner, rng.integers(0, 3, n), -1).astype(np.int32), rng.integers(0, 256, (n, 32)).astype(np.uint8),
                           np.where(inner, 2 * at + 1, 0).astype(np.int32), np.where(inner, 2 * at + 2, 0).astype(np.int32), np.zeros(n), np.zeros(n))
    codes = rng.integers(0, 256, (3, 4000)).astype(np.uint8)

    def leaf(x):
        i = 0
        while tree.feature[i] >= 0:
            c = x[tree.feature[i]]
            i = tree.left[i] if tree.goes_left[i, c >> 3] >> (c & 7) & 1 else tree.right[i]
        return i

    want = np.array([leaf(x) for x in codes.T.tolist()])
    rows = np.flatnonzero(rng.random(4000) < 0.3)
    for bound in (1, 10**9):
        monkeypatch.setattr(flat_trees, "ROWS_PER_SPLIT", bound)
        assert (tree.leaf_of(codes) == want).all() and (tree.leaf_of(codes, rows) == want[rows]).all()
        assert len(tree.leaf_of(codes, rows[:0])) == 0


def test_guided_search_packs_its_rows_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(a), float(a > 0.5) + float(b) / 10) for i, (a, b) in enumerate(rng.random((200, 2)))]
    df = spark.createDataFrame(rows, "row_id long, fold int, a double, y double")
    packed, pack = [], search.pack
    monkeypatch.setattr(search, "pack", lambda *a, **k: packed.append(pack(*a, **k)) or packed[-1])
    ranges, known = {"num_leaves": (2, 6), "lambda_l2": (0.1, 2.0)}, {"num_leaves": 4, "lambda_l2": 1.0}
    base = leafwise.LeafwiseParams(n_rounds=2, min_data_in_leaf=5, learning_rate=0.5)
    trials = search.guided_search(df, ["a"], "y", "fold", str(tmp_path / "trials"), base, ranges, known, 1, 2).orderBy("trial").collect()
    assert len(trials) == 4 and len(packed) == 1
    assert not list(Path(packed[0].path.removeprefix("file:")).glob("*"))
    for t in trials:                                            # the same as a fleet on blocks of its own
        own = leafwise.train_fleet(df, ["a"], "y", fold="fold", params=[replace(base, num_leaves=int(t.num_leaves), lambda_l2=t.lambda_l2)])
        assert abs(np.mean([min(m.history) for m in own.models.values()]) - t.rmse) < 1e-12
