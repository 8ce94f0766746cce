"""Exact dedup against a plain dictionary of stripped texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from wattle.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        s = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        g = sorted(groups[s])
        out.append((i, g[0][2], len(g), hashlib.sha256(s.encode()).hexdigest()))
    return out


def test_fingerprints_compose():
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 200_000, np.uint8)
    whole = X.fingerprints(data, np.array([0, len(data)]))[0]
    for cut in (0, 1, 65_536, 70_001, len(data)):
        left, right = X.fingerprints(data, np.array([0, cut, len(data)]))
        assert X.combine(left, right, len(data) - cut) == whole
    slow = [0, 0, 0, 0]
    for b in data[:300].tolist():
        slow = [(v * x + b + 1) % p for v, (p, x) in zip(slow, X.MODULI, strict=True)]
    assert X.fingerprints(data[:300], np.array([0, 300]))[0] == slow


def texts():
    r = random.Random(4)
    base = ["", "a", "ab", "a b", " a b ", " a", "é東京", "é 東\n京", "x" * 5000, "x " * 5000, None, " \t\n\x0b\x0c\r "]
    long = "".join(r.choice("abc \n") for _ in range(300_000))
    return base + [long, long.replace(" ", "  "), long[:-1] + "d"] + [r.choice(base) for _ in range(40)]


def test_matches_brute_force(frame):
    rows = list(enumerate(texts()))
    want = brute(rows)
    for options in ({}, {"huge": 2000, "piece": 700}):
        got = X.exact_dedup(frame([t for _, t in rows]), **options).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert {r.doc_id for r in got if r.kept} == {r.keep_id for r in got}


def test_ties_null_ids_and_clashing_columns(frame):
    df = frame(["t", "t", "t", " t", None, None], ids=[7, 7, None, 9, None, 3]).selectExpr("*", "1 AS row", "'x' AS n", "2 AS k1", "3 AS points")
    got = X.exact_dedup(df).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 2
    assert {(r.keep_id, r.group_size) for r in got} == {(9, 4), (3, 2)}
    tie = X.exact_dedup(frame(["t", "t", "t"], ids=[7, 7, None])).collect()
    assert [r.doc_id for r in tie if r.kept] == [7]
    assert X.exact_dedup(df.limit(0)).collect() == []


def test_different_texts_under_one_fingerprint_are_told_apart(frame, monkeypatch):
    monkeypatch.setattr(X, "_fingerprint", _blind(X._fingerprint))
    got = X.exact_dedup(frame(["aaaa", "aaab", "aaaa", "cc"])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 0, 2), (1, 1, 1), (2, 0, 2), (3, 3, 1)]


def _blind(real):
    def run(batches):
        import pyarrow as pa
        for b in real(batches):
            zero = pa.array([0] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), zero, zero, *[b.column(i) for i in (4, 5, 6)]], names=b.schema.names)
    return run
