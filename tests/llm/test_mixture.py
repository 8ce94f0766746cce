"""Mixture: targets by resharing round by round, schedule and bounds by direct count."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from wattle.llm import mixture as M


def reshare(sizes, weights=M.WEIGHTS, share=M.SHARE, repeat=M.REPEAT):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    rest = share * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        give = {s: rest * w[s] / total for s in open_}
        rest = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= repeat * sizes[s]:
                rest += target[s] - repeat * sizes[s]
                target[s] = repeat * sizes[s]
                open_.discard(s)
    return target


@pytest.fixture
def docs(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        s = r.choice(["hot"] * 8 + ["a", "b", "c", None, "é", "Z", "tiny", "void"])
        n = 0 if s == "void" else r.choice([0, 1, 3, 50, 200, 2000])
        rows.append((i, None if n == 0 and r.random() < 0.5 else " ".join(["w"] * n), s))
    rows.append((1000, "w " * 9, "tiny"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS row", "3 AS taken", "4 AS part").repartition(4)


@pytest.mark.parametrize("weights", [(3, 1, 2), (1,), (50, 1, 1, 1, 1, 1, 1, 1, 1)])
def test_targets_and_bounds(docs, weights):
    rows, df = docs
    got = M.mixture(df, weights=weights).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = reshare(sizes, weights)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert taken[s] == int(t + 1e-6), (s, t, taken[s])


def test_reruns_and_grouping_agree(docs, monkeypatch):
    _, df = docs
    one = sorted((r.doc_id, r.taken) for r in M.mixture(df).collect())
    assert one == sorted((r.doc_id, r.taken) for r in M.mixture(df.repartition(7)).collect())
    monkeypatch.setattr(M, "GROUP_ROWS", 10)
    monkeypatch.setattr(M, "STRETCH", 50)
    assert one == sorted((r.doc_id, r.taken) for r in M.mixture(df).collect())


def test_documents_of_the_mix(docs):
    _, df = docs
    plan = {r.doc_id: r.taken for r in M.mixture(df).collect() if r.taken}
    got = M.mixed_documents(df.drop("taken"))
    assert got.columns == [*df.drop("taken").columns, "taken"]
    assert {r.doc_id: r.taken for r in got.collect()} == plan
    assert M.mixed_documents(df).columns == [*df.columns, "_taken"]


def test_empty_repeated_and_wordless(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (None, None, None)], "doc_id long, text string, source string")
    got = M.mixture(df).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 6
    assert M.mixture(df.limit(0)).collect() == []
    assert [r.taken for r in M.mixture(df.filter("text IS NULL")).collect()] == [0]
