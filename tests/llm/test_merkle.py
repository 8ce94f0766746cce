"""Merkle manifest against a plain reading of the rule."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from wattle.llm import merkle as M


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """(root, per leaf the list of (before, after) digests on its way up)."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, path in enumerate(paths):
            lo = at[i] // 16 * 16
            path.append(("".join(digests[lo:at[i]]), "".join(digests[at[i] + 1:lo + 16])))
        digests = [h("".join(digests[k:k + 16])) for k in range(0, len(digests), 16)]
        at = [a // 16 for a in at]
    return digests[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, upper, strict=True):
        sub, paths = trees[s]
        for (known, i, d, r), path in zip(sorted(by[s], key=lambda x: x[:3]), paths, strict=True):
            found = d
            if known and zlib.crc32(str(i).encode()) % 5 == 0 and r[4] is not None:
                found = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            folded = found
            for a, b in path + top:
                folded = h(a + folded + b)
            out.append((r[0], d, sub, root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest int, tree int, steps int"


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(partitions)
    got = Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                  for r in M.proofs(df).collect())
    assert got == Counter(brute(rows))
    return got


def corpus(sizes, seed=1):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "béta", "東", "x", "", "GAMMA"])
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows) * 3 - 40, s, r.choice(["en", None, "de"]), r.choice([None, 0, 7, 10**12]), r.choice([None, "", word() + " " + word()])))
    r.shuffle(rows)
    return rows


def test_sources_of_many_sizes(spark):
    got = check(spark, corpus({"a": 1, "b": 16, "c": 17, None: 33, "": 2, "é": 15, "z": 300, "Z": 257}))
    assert {k[-1] for k in got} == {True, False}


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {None: 18}, {f"s{i}": 1 for i in range(20)}])
def test_small_shapes(spark, sizes):
    check(spark, corpus(sizes))


def test_equal_ids_equal_rows_and_null_ids(spark):
    rows = corpus({"a": 20, "b": 5})
    rows += rows[:6] + [(7, "a", "en", 1, "T"), (7, "a", "en", 1, "t"), (None, "a", None, None, None), (None, "a", None, None, None), (None, None, None, None, "Q")]
    check(spark, rows)


def test_long_text_and_empty_table(spark):
    rows = [(5, "a", "en", 3, "Long É " * 300_000), (10, "a", "en", 3, "B")]
    check(spark, rows, 1)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert M.proofs(df.limit(0)).collect() == []
