"""Contamination against a window-by-window search."""

from __future__ import annotations

import random
import re

import pytest

from wattle.llm.decontaminate import decontaminate, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, n=13):
    items = [(i, WORD.findall(fold(t))) for i, t in bench]
    out = []
    for i, t in docs:
        w = WORD.findall(fold(t))
        hit, found = set(), set()
        for item, b in items:
            if not b:
                continue
            ln = min(n, len(b))
            wins = {tuple(b[p:p + ln]) for p in range(len(b) - ln + 1)}
            for p in range(len(w) - ln + 1):
                if tuple(w[p:p + ln]) in wins:
                    hit.update(range(p, p + ln))
                    found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture
def tables():
    r = random.Random(8)
    word = lambda: r.choice("The of Éclair éclair x1 2 alpha BETA straße 東京 kK".split())
    bench = [" ".join(word() for _ in range(n)) for n in (30, 13, 12, 1, 5, 20)] + [None, "", "...", "alpha"]
    bench[3] = "unusualword"
    bench[9] = "rareterm"
    docs = [None, "", "!!", "unusualword", "x UNUSUALWORD-rareterm y"]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 6)):
            b = r.choice(bench[:6])
            c = r.random()
            parts.append(b.upper() if c < 0.15 else b if c < 0.35 else " ".join(word() for _ in range(r.randint(1, 60))))
        docs.append(r.choice([" ", ", ", "\n"]).join(parts))
    docs.append(" ".join(docs[5:30]) * 4)
    return docs, list(enumerate(bench)) + [(2, bench[2])]


@pytest.mark.parametrize("bound", [100_000, 3])
def test_matches_brute_force(spark, frame, tables, bound):
    docs, bench = tables
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = matches(frame(docs), b, broadcast_windows=bound).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in got) == brute(list(enumerate(docs)), bench)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_removal_keeps_columns_and_cuts_spans(spark, frame, tables):
    docs, bench = tables
    b = spark.createDataFrame(bench, "item_id long, text string")
    df = frame(docs).selectExpr("*", "1 AS row", "2 AS dec_row", "3 AS p")
    bad = {r[0] for r in brute(list(enumerate(docs)), bench) if r[4]}
    left = decontaminate(df, b)
    assert left.columns == df.columns
    assert {r.doc_id: r.text for r in left.collect()} == {i: t for i, t in enumerate(docs) if i not in bad}
    cut = {r.doc_id: r.text for r in decontaminate(df, b, mode="spans").collect()}
    for (i, n, n_hit, _, _) in brute(list(enumerate(docs)), bench):
        assert len(WORD.findall(fold(cut[i]))) == n - n_hit
        assert cut[i] == docs[i] or n_hit


@pytest.mark.parametrize("bound", [100_000, 0])
def test_one_long_text_on_either_path(spark, frame, bound):
    """The hits of a text of 60,000 words, by broadcast and by shuffle (no broadcast at all there)."""
    r = random.Random(3)
    w = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    bench = spark.createDataFrame([(k, " ".join(w[p:p + 20])) for k, p in enumerate(range(0, 60_000, 6000))], "item_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not bound:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        (got,) = matches(frame([" ".join(w)]), bench, broadcast_windows=bound).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert (got.n_words, got.n_hit, len(got["items"])) == (60_000, 200, 10)
    assert [(s.start, s.end) for s in got.spans] == [(p, p + 20) for p in range(0, 60_000, 6000)]


def test_empty_tables_and_repeated_rows(spark, frame):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = frame(["One TWO three", "One TWO three"], ids=[4, 4])
    assert [(r.doc_id, r.n_hit) for r in matches(df, bench).collect()] == [(4, 3), (4, 3)]
    assert [r.n_hit for r in matches(df, bench.limit(0)).collect()] == [0, 0]
    assert matches(df.limit(0), bench).collect() == []
    assert decontaminate(df.limit(0), bench).collect() == []


def test_hits_are_not_broadcast_by_the_size_of_their_file(spark, frame):
    """Hits of few windows are a small file however many they are: no join takes them to the driver."""
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    docs = frame([" ".join(f"w{i}" for i in range(40))] * 50 + ["nothing here"])
    out = matches(docs, bench)
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert joins and not [x for x in joins if "BroadcastHashJoin" in x and "LeftSemi" not in x]
    assert sorted(r.n_hit for r in out.collect()) == [0] + [40] * 50


def test_windows_of_many_items_are_not_broadcast(spark, frame, monkeypatch):
    from wattle.llm import decontaminate as D
    bench = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20))) for i in range(300)], "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_BYTES", 10_000, raising=False)
    plans, saved = {}, D.saved
    monkeypatch.setattr(D, "saved", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and saved(df, name))
    (row,) = matches(frame([" ".join(f"w{j}" for j in range(20))]), bench).collect()
    assert "Broadcast" not in plans["hits"]
    assert row.n_hit == 20 and len(row["items"]) == 300
