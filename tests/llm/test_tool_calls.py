"""Tool-call linking against a plain reading of the messages."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from wattle.llm import tool_calls as T

SCHEMA = ("conv string, turn long, role string, content string, "
          "calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, result_for string")


def by_id(df):
    return {(r.conv, r.id): r for r in T.format_tool_calls(df).collect()}


def call(i, name="search", arguments='{"query": "q", "limit": 3}', after=()):
    return (i, name, arguments, list(after) if after is not None else None)


def test_links_order_and_records(spark):
    rows = [
        ("c", 0, "user", "hi", [], None),
        ("c", 1, "assistant", None, [call("a", arguments='{"limit": 3,"query":"é",  "exact": true}'), call("b", after=["a"])], None),
        ("c", 2, "tool", "result a", [], "a"),
        ("c", 3, "tool", "second a", [], "a"),
        ("c", 4, "assistant", None, [call("x", after=["z", "nowhere"]), call("y", after=["x"])], None),
        ("c", 5, "assistant", None, [call("z", after=["b", "z"])], None),
        ("c", 6, "assistant", None, [call("l1", after=["l2"]), call("l2", after=["l1"]), call("l3", after=["l1"])], None),
        ("c", 7, "tool", "lost", [], "ghost"),
        ("c", 8, "assistant", None, [call("a", name="other")], None),
        (None, 1, "assistant", None, [call("n", after=None)], None),
        (None, 2, "tool", "r", [], "n"),
    ]
    got = by_id(spark.createDataFrame(rows, SCHEMA).withColumn("idx", F.lit(1)))
    c = {i: got["c", i] for k, i in got if k == "c"}
    assert (c["a"].n_calls, c["a"].n_results, c["a"].linked, c["a"].errors) == (2, 2, True, [])
    assert json.loads(c["a"].json) == {"id": "a", "name": "search", "arguments": {"exact": True, "limit": 3, "query": "é"},
                                       "result": "result a", "errors": [], "seq": 0}
    assert c["a"].json == json.dumps(json.loads(c["a"].json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert [c[i].wave for i in ("a", "b", "z", "x", "y")] == [0, 0, 0, 1, 2]
    assert [c[i].seq for i in ("a", "b", "z", "x", "y")] == [0, 1, 2, 4, 5]
    assert c["x"].errors == ["reference:nowhere"] and c["z"].errors == ["reference:z"]
    assert all(c[i].wave is None and c[i].seq is None and "order:cycle" in c[i].errors for i in ("l1", "l2", "l3"))
    assert (c["ghost"].linked, c["ghost"].errors, c["ghost"].seq) == (False, ["call:missing"], 3)
    assert got[None, "n"].linked and got[None, "n"].seq == 0


@pytest.mark.parametrize("name, arguments, errors", [
    ("search", '{"query": "q", "limit": 3}', []),
    ("search", '{"query": 1, "limit": "3"}', ["type:limit", "type:query"]),
    ("search", '{"limit": 3.5, "exact": null}', ["missing:query", "type:exact", "type:limit"]),
    ("search", '{"query": "q", "limit": 3, "b c": 1, "a": 2}', ["unknown:a", "unknown:b c"]),
    ("summarise", '{"text": "", "max_words": 1, "ratio": 2}', []),
    ("summarise", '{"text": "", "max_words": 1, "ratio": 0.5}', []),
    ("translate", '{"text": "t", "target": "en", "options": []}', ["type:options"]),
    ("translate", '{"text": "t", "target": "en", "options": {}}', []),
    ("search", '{"query": "q", "limit": 12345678901234567890}', []), ("search", '{"query": "q", "limit": 100000000000000000000}', []),
    ("search", '{"query": "q", "limit": 1e3}', ["type:limit"]),
    ("nothing", '{}', ["tool:unknown"]), (None, '{}', ["tool:unknown"]),
    ("search", None, ["arguments:malformed"]), ("search", "[1]", ["arguments:malformed"]), ("search", "{", ["arguments:malformed"]),
    ("search", '{"query": "q", "query": "r", "limit": 1}', ["arguments:malformed"]),
])
def test_argument_errors(spark, name, arguments, errors):
    df = spark.createDataFrame([(name, arguments)], "name string, arguments string")
    assert df.select(T.argument_errors(F.col("name"), F.col("arguments")).alias("e")).first().e == errors


def test_order_respects_references_in_random_transcripts(spark, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 4)
    r = random.Random(12)
    rows, refs = [], {}
    for conv in "pqr":
        order = [f"k{i}" for i in range(25)]
        r.shuffle(order)
        for turn, i in enumerate(order):
            n = int(i[1:])
            refs[conv, i] = [f"k{j}" for j in r.sample(range(n), min(n, r.randint(0, 2)))]    # acyclic by number
            rows.append((conv, turn, "assistant", None, [call(i, after=refs[conv, i])], None))
    got = by_id(spark.createDataFrame(rows, SCHEMA).repartition(3))
    for conv in "pqr":
        assert sorted(x.seq for (c, _), x in got.items() if c == conv) == list(range(25))
    for (conv, i), needs in refs.items():
        assert all(got[conv, j].seq < got[conv, i].seq for j in needs)


def test_ids_that_are_missing_are_rows_of_their_own(spark):
    rows = [("c", 0, "assistant", None, [call(None), call("a"), call(None, name="none")], None), ("c", 1, "tool", "lost", [], None),
            ("c", 1, "tool", "lost", [], None), ("c", 2, "tool", "got", [], "a"), ("c", None, "user", "no result", [], None),
            (None, None, "assistant", None, [call(None, after=["a", None])], None)]
    got = T.format_tool_calls(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r.conv or "", r.turn if r.turn is not None else -1, r.idx, r.n_calls, r.n_results, tuple(r.errors), r.seq)
    assert sorted(map(key, (r for r in got if r.id is None))) == sorted([
        ("c", 0, 0, 1, 0, ("id:missing",), None), ("c", 0, 2, 1, 0, ("id:missing", "tool:unknown"), None),
        ("c", 1, 0, 0, 1, ("id:missing", "call:missing"), None), ("c", 1, 0, 0, 1, ("id:missing", "call:missing"), None),
        ("", -1, 0, 1, 0, ("id:missing",), None)])
    assert [(r.id, r.linked, r.seq) for r in got if r.id] == [("a", True, 0)]
    assert [json.loads(r.json)["result"] for r in got if r.errors[1:] == ["call:missing"]] == ["lost", "lost"]


def plain_transcripts(talk):
    """(conv, id, seq) and linked of every call and result, one conversation at a time in plain Python."""
    out = []
    for conv in {c for c, *_ in talk}:
        calls, results = {}, {}
        for _, turn, role, text in sorted((x for x in talk if x[0] == conv and x[1] is not None), key=lambda x: x[1]):
            n = len(text or "")
            if role == "user":
                back = [turn + 2] if n % 11 == 0 else [turn - 2, turn - 4] if n % 3 == 0 else []
                calls[turn] = back
            elif role == "assistant":
                results[turn - 1] = turn
        out += [(conv, None, None, False)] * sum(1 for x in talk if x[0] == conv and x[1] is None and x[2] in ("user", "assistant"))
        wave, left = {}, dict(calls)
        known = {t: [b for b in back if b in calls and b != t] for t, back in calls.items()}
        moved = {t for t in calls if any(b > t for b in known[t])}
        while (more := {t for t in calls if t not in moved and any(b in moved for b in known[t])}):
            moved |= more
        wave = {t: 0 for t in calls if t not in moved}
        left, w = set(moved), 0
        while left:
            w += 1
            free = {t for t in left if not any(b in left for b in known[t])}
            if not free:
                break
            wave |= dict.fromkeys(free, w)
            left -= free
        rows = [(wave[t], t, f"call-{t}") for t in wave] + [(0, turn, f"call-{t}") for t, turn in results.items() if t not in calls]
        seq = {i: n for n, (_, _, i) in enumerate(sorted(rows))}
        for t in calls.keys() | results.keys():
            out.append((conv, f"call-{t}", seq.get(f"call-{t}"), t in calls and t in results))
    return out


def test_transcripts_equal_a_plain_version(spark):
    r = random.Random(5)
    talk = [(str(c), t if r.random() > 0.05 else None, r.choice(["user", "user", "assistant", "system"]), "x" * r.randint(0, 40))
            for c in range(30) for t in range(r.randint(0, 12))]
    df = spark.createDataFrame(talk, "conv_id string, turn long, role string, text string")
    got = [(x.conv, x.id, x.seq, x.linked) for x in T.format_tool_calls(T.transcripts(df)).collect()]
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=order) == sorted(plain_transcripts(talk), key=order)


def test_transcripts_and_empty_tables(spark):
    talk = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", 'say "x"\n'), (1, 2, "assistant", "ok"), (1, 3, "user", None), (2, 0, "user", "u")],
                                 "conv_id long, turn long, role string, text string").withColumn("calls", F.lit(1))
    got = by_id(T.transcripts(talk))
    assert set(got) == {("1", "call-1"), ("1", "call-3"), ("2", "call-0")}
    assert got["1", "call-1"].linked and not got["2", "call-0"].linked
    assert T.format_tool_calls(T.transcripts(talk.limit(0))).collect() == []
