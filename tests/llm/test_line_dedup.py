"""Line dedup against exact distinct counts."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from wattle.llm import line_dedup as L


def brute(rows, min_sites):
    strip = lambda x: x.strip(" \t\r")
    sites, ids = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if strip(line):
                sites[strip(line)].add(s)
                ids[strip(line)].add((i is None, i))
    gone = {k: min(ids[k])[1] for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        keep = [x for x in lines if strip(x) not in gone or gone[strip(x)] == i]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


@pytest.fixture
def rows():
    r = random.Random(6)
    common = [f"a line that is found in many places, number {k}" for k in range(8)] + ["short", "", "   padded but long enough   \r"]
    out = []
    for i in range(150):
        lines = [r.choice(common) if r.random() < 0.4 else f"own line {r.random()} of document" for _ in range(r.randint(0, 8))]
        out.append((i, "\n".join(lines), r.choice([None, *[f"s{k}" for k in range(12)]])))
    return out + [(200, None, "s1"), (201, "", "s1"), (202, "\n\n", None), (203, "\n".join([common[0]] * 5), "s3"), (203, common[0], "s9")]


@pytest.mark.parametrize("min_sites", [2, 6, 9, 13])
def test_matches_brute_force(spark, rows, min_sites):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "2 AS line_gone", "3 AS owner").repartition(3)
    got = L.line_dedup(df, min_sites=min_sites, counts=("n_lines", "n_removed"))
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == sorted(brute(rows, min_sites), key=str)


def test_near_threshold_lines_get_exact_counts(spark):
    """With a coarse sketch and a wide band the exact pass decides."""
    data = [(f"line {k:03d} that is long enough", f"site{j}", j) for k in range(60) for j in range(40 + k)]
    lines = spark.createDataFrame(data, "line string, site string, id long").select(L._key(L.F.col("line")).alias("key"), "site", "id")
    got = L.boilerplate(lines, min_sites=70, bits=4, band=0.9).collect()
    assert len(got) == 30 and all(r.owner.id == 0 for r in got)


def test_short_lines_ties_and_a_long_text(spark):
    long = "\n".join(f"own {i}" for i in range(40_000))
    data = [(1, "Les.", "a"), (1, "Les.\nx", "b"), (2, "Les.\n \n" + long, "c"), (3, "Les.", "d")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text) for r in L.line_dedup(df, min_sites=3).collect())
    assert got == [(1, "Les."), (1, "Les.\nx"), (2, " \n" + long), (3, "")]


def test_null_ids_and_empty_table(spark):
    line = "the very same line everywhere"
    df = spark.createDataFrame([(None, line, "a"), (None, line, "b"), (3, line, "c")], "doc_id long, text string, source string")
    got = L.line_dedup(df, min_sites=3).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("3", line), ("None", ""), ("None", "")]
    assert L.line_dedup(df.limit(0)).collect() == []
