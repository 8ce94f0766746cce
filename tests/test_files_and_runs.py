"""Arrow files, ordered CSV, bucketed facts, bitmaps, dealt runs and mergeable profiles
against plain versions."""

from __future__ import annotations

import random
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.operators import aggregate, clean, folds, profiles
from wattle.sources import arrow_files, bucketed, ordered
from wattle.sources.files import WrittenPart, data_files


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="wattle-files-")


def frame(n: int) -> pd.DataFrame:
    r = np.random.default_rng(3)
    return pd.DataFrame({"id": np.arange(n), "kind": pd.Categorical(r.choice(["a", "b", "é,\n"], n)), "value": np.where(r.random(n) < 0.1, np.nan, r.random(n)),
                         "at": pd.Timestamp("2016-01-01") + pd.to_timedelta(np.arange(n), "h"), "unused": "x"})


def test_feather_files_scan(spark, folder):
    pdf = frame(1000)
    pa.feather.write_feather(pdf[:700], f"{folder}/a.feather", chunksize=100)
    pa.feather.write_feather(pdf[700:], f"{folder}/b.feather", chunksize=150)
    pa.feather.write_feather(pdf, f"{folder}/.hidden.feather")
    df = arrow_files.read_arrow(spark, folder, ["at", "kind", "value", "id"])
    assert df.columns == ["at", "kind", "value", "id"] and dict(df.dtypes)["at"] == "timestamp_ntz" and df.rdd.getNumPartitions() == 9
    got = {r.id: (r.at, r.kind) for r in df.collect()}
    assert got == {i: (at.to_pydatetime(), k) for i, at, k in zip(pdf.id, pdf["at"], pdf.kind)}
    some = df.filter("id >= 650 AND kind = 'a' AND value IS NOT NULL").select("id")
    assert sorted(r.id for r in some.collect()) == sorted(pdf.id[(pdf.id >= 650) & (pdf.kind == "a") & pdf.value.notna()])
    with pytest.raises(Exception, match="no .arrow"):
        arrow_files.read_arrow(spark, tempfile.mkdtemp()).count()


def test_arrow_sink_and_empty_table(spark, folder):
    df = spark.range(0, 5000, 1, 4).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("t"), F.array("id").alias("list"))
    path = arrow_files.write_arrow(df, f"{folder}/out")
    assert len(data_files(path, arrow_files.SUFFIXES)) == 4
    assert arrow_files.read_arrow(spark, path).exceptAll(df).count() == 0 and arrow_files.read_arrow(spark, path).count() == 5000
    arrow_files.write_arrow(df.filter("id < 10"), path)                      # replaced, not added
    assert arrow_files.read_arrow(spark, path).count() == 10


def test_large_batches():
    batches = [pa.record_batch({"a": list(range(i, i + 10))}) for i in range(0, 100, 10)]
    out = list(arrow_files.large_batches(batches, 240))
    assert [b.num_rows for b in out] == [30, 30, 30, 10] and pa.Table.from_batches(out)["a"].to_pylist() == list(range(100))


@pytest.mark.parametrize("writer", [arrow_files.ArrowWriter, lambda p, o: ordered.OrderedWriter(p, o, ["a"])])
def test_a_repeated_attempt_is_no_part(folder, writer):
    w = writer(f"{folder}/out", True)
    batch = pa.record_batch({"a": [1, 2]})
    w.write(iter([batch]))                                                   # an attempt that Spark does not report
    kept = w.write(iter([batch]))
    late = WrittenPart(kept.partition + 1, w.write(iter([pa.record_batch({"a": [3]})])).file, 1)
    w.commit([late, None, kept])
    files = data_files(f"{folder}/out", (".csv", ".arrow"))
    assert len([f for f in files if "header" not in f]) == 2 and not any("_staged" in f for f in pa.fs.LocalFileSystem().get_file_info(pa.fs.FileSelector(f"{folder}/out")) for f in [f.path])
    other = writer(f"{folder}/out", False)
    other.write(iter([batch]))
    other.abort([])
    with pytest.raises(FileExistsError):
        other.commit([other.write(iter([batch]))])


def test_failed_job_leaves_the_old_files(spark, folder):
    path = ordered.write_ordered(spark.range(100).select("id"), f"{folder}/out", ["id"])
    bad = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        ordered.write_ordered(bad, path, ["id"])
    assert ordered.read_ordered(spark, path, T.StructType([T.StructField("id", T.LongType())])).count() == 100


def test_ordered_parts_concatenate(spark, folder):
    r = random.Random(4)
    rows = [(i, r.choice(['a"b', "c,d", "e"]), None if i % 7 == 0 else i / 8) for i in r.sample(range(10 ** 6), 3000)]
    df = spark.createDataFrame(rows, "id long, t string, v double").repartition(5)
    path = ordered.write_ordered(df, f"{folder}/out", ["id"], 6)
    files = data_files(path, (".csv",))
    assert len(files) == 7
    joined = f"{folder}/joined.csv"
    with open(joined, "wb") as out:
        for f in files:
            out.write(open(f, "rb").read())
    got = pd.read_csv(joined)
    assert [(a, b, None if np.isnan(c) else c) for a, b, c in got.itertuples(index=False)] == sorted(rows)
    with pytest.raises(ValueError, match="format"):
        ordered.write_ordered(df.withColumn("d", F.current_date()), f"{folder}/no", ["id"])


def test_bucketed_facts_join_without_a_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(1000).select((F.col("id") % 40).alias("b"), (F.col("id") % 3).cast("string").alias("m"), "id")
        x = bucketed.write_bucketed(a.unionByName(a.limit(1).withColumn("b", F.lit(None).cast("long"))), ["b", "m"], 4)
        y = bucketed.write_bucketed(a.withColumnRenamed("id", "other"), ["b", "m"], 4)
        j = x.join(y, ["b", "m"]).groupBy("b", "m").agg(F.count("*").alias("n"))
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert x.count() == 1001 and j.count() == a.select("b", "m").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bitmap_equals_anti_join(spark):
    r = random.Random(6)
    bad = [r.randint(-300, 3000) for _ in range(800)] + list(range(1000, 2000)) + [None, 2 ** 62]
    df = spark.createDataFrame([(i,) for i in [*range(-400, 3500), 2 ** 62, None]], "row_id long").withColumn("x", F.lit(1))
    b = spark.createDataFrame([(i,) for i in bad], "pos long")
    bitmap = clean.position_bitmap(b)
    got, want = clean.drop_by_bitmap(df, bitmap), clean.drop_bad_rows(df, b)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == df.columns
    assert bitmap.count() < len(set(bad)) / 10
    assert clean.drop_by_bitmap(df, clean.position_bitmap(b.limit(0))).count() == df.count()


def greedy(sizes, k):
    load, out = [0] * k, {}
    for g, n in sorted(sizes, key=lambda x: (-x[1], x[0] is None, -(x[0] or 0))):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += n
        out[g] = f
    return out, load


def test_runs_are_dealt_as_the_greedy_rule_does():
    r = random.Random(7)
    for _ in range(400):
        k = r.randint(1, 6)
        sizes = sorted((r.randint(1, 9) for _ in range(r.randint(0, 60))), reverse=True)
        want, load = greedy(list(enumerate(sizes)), k)      # larger group values first: reversed below
        mine, got = [0] * k, []
        for size in sorted(set(sizes), reverse=True):
            n, pieces = sizes.count(size), folds.deal_run(mine, size, sizes.count(size))
            assert [p[0] for p in pieces][:1] == [0] and pieces[-1][1] == n and len(pieces) <= k
            got += [f[(t - a) % len(f)] for a, b, f in pieces for t in range(a, b)]
        assert mine == load
        order = sorted(enumerate(sizes), key=lambda x: (-x[1], -x[0]))
        assert got == [want[g] for g, _ in order]


def test_group_folds_with_ties_and_null(spark):
    r = random.Random(8)
    sizes = [(g, r.choice([1, 1, 1, 2, 3, 17])) for g in [*range(120), None]]
    df = spark.createDataFrame([(g,) for g, n in sizes for _ in range(n)], "g long").repartition(3)
    got = {x.g: x.fold for x in folds.group_fold_table(df, 4, "g").collect()}
    assert got == greedy(sizes, 4)[0]
    assert folds.folds_group(df, 4, "g").filter("fold IS NULL").count() == 0


def test_merged_profiles_equal_profiles_of_the_rows(spark):
    r = np.random.default_rng(9)
    n = 60_000
    pdf = pd.DataFrame({"k": r.choice(["a", "b", "c"], n, p=[0.9, 0.0999, 0.0001]), "fold": r.integers(0, 3, n), "v": r.lognormal(size=n) + 1000})
    pdf.loc[pdf.index[:50], "v"] = np.nan
    one = pd.DataFrame({"k": ["one", "flat", "flat", "flat", "none"], "fold": [1, 0, 1, 2, 0], "v": [5.0, 2.0, 2.0, 2.0, np.nan]})
    pdf = pd.concat([pdf, one])
    df = spark.createDataFrame(pdf)
    got = {(x.k, x.fold): x for x in profiles.profile_other_folds(df, ["k"], "v", "fold", 3).collect()}
    want = {}
    for f in range(3):
        for k, g in pdf[pdf.fold != f].dropna().groupby("k"):
            want[k, f] = g.v
    assert set(got) == set(want)
    for key, v in want.items():
        x = got[key]
        assert x.v_count == len(v) and x.v_min == v.min() and x.v_max == v.max()
        for name, value in (("mean", v.mean()), ("std", v.std()), ("skew", v.skew()), ("kurt", v.kurt())):
            mine = x[f"v_{name}"]
            assert (mine is None and np.isnan(value)) or mine == pytest.approx(value, rel=1e-6, abs=1e-6), (key, name)
        for q, p in profiles.QUANTILES.items():
            at = x[f"v_{q}"]
            assert (v < at).mean() - 0.01 <= p <= (v <= at).mean() + 0.01, (key, q)
    safe = aggregate.profile_fold_safe(df.dropna(), ["k"], "v", "fold", 3, ("mean", "std"))
    for x in safe.collect():
        assert got[x.k, x.fold].v_mean == pytest.approx(x.v_mean, rel=1e-12)
