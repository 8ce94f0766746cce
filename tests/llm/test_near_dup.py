"""Near duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from wattle.llm import near_dup as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return []
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def chain(a, b):
    """Longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def similarity(a, b):
    n = chain(a, b)
    return n / (len(a) + len(b) - n) if a and b else 0.0


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        i = r.randrange(len(out))
        c = r.random()
        if c < 0.5:
            out[i] = f"new{r.randrange(10**6)}"
        elif c < 0.75:
            del out[i]
        else:
            out.insert(i, f"more{r.randrange(10**6)}")
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(500)] + ["the", "of", "é"]
    shared = [r.choice(vocab) for _ in range(30)]
    out = []
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 8, 60, 150, 300]))]
        if g % 3 == 0:
            base = base + shared
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            w = edited(r, base, r.choice([0, 1, 2, 3, 5, 9]) if len(base) > 20 else 0)
            out.append(r.choice([" ", "\n", ", "]).join(w).upper() if r.random() < 0.3 else " ".join(w))
    out += [None, "", "  ...", "one", "One!", "a b c", "line of words again " * 50, "line of words again " * 47]
    half = [r.choice(vocab) for _ in range(100)]
    out += [" ".join(half[:50] + half[50:]), " ".join(half[50:] + half[:50])]        # same k-mers, other order
    return out


def brute(rows):
    sh = {i: shingles(t) for i, t in rows}
    links = {(i, j) for i in sh for j in sh if i < j and sh[i] and sh[j] and similarity(sh[i], sh[j]) >= 0.8}
    label = {i: i for i in sh}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in links:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return {i: root(i) for i in sh}, links


def test_classes_match_brute_force(frame, texts):
    want, links = brute(list(enumerate(texts)))
    got = {r.doc_id: r for r in N.near_duplicates(frame(texts)).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[want[i]] and r.kept == (want[i] == i) for i, r in got.items())
    assert len(links) > 60 and len(set(want.values())) < len(texts)


def test_alignment_is_exact_from_the_threshold_up():
    r = random.Random(7)
    for _ in range(300):
        a = r.sample(range(200), r.randint(10, 60))
        b = edited(r, a, r.randint(0, 8)) if r.random() < 0.8 else r.sample(a, len(a))
        b = [x if isinstance(x, int) else 1000 + hash(x) % 10**6 for x in b]
        b = list(dict.fromkeys(b))
        if not b:
            continue
        want = similarity(a, b)
        got = N.aligned_similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert (got == pytest.approx(want)) if want >= 0.8 else got < 0.8


def test_order_matters(frame):
    r = random.Random(1)
    w = [f"w{r.randrange(10**6)}" for _ in range(200)]
    a, b = " ".join(w), " ".join(w[100:] + w[:100])
    assert {r.class_id for r in N.near_duplicates(frame([a, b])).collect()} == {0, 1}


def test_recall_in_a_large_group_of_near_copies(frame):
    """Hundreds of near copies of one text around a shared passage all meet."""
    r = random.Random(5)
    base = [f"w{r.randrange(300)}" for _ in range(300)]
    ts = [" ".join(edited(r, base, 3)) for _ in range(300)] + [" ".join([f"x{r.randrange(10**6)}" for _ in range(200)] + base[:60]) for _ in range(200)]
    got = N.near_duplicates(frame(ts)).collect()
    assert sum(r.class_id == 0 for r in got) == 300 and sum(r.class_size == 1 for r in got) == 200


def test_kept_documents_ties_nulls_and_columns(spark, frame):
    t = "some words that make a text of a few k mers here"
    df = frame([t, t, t.upper(), None, None], ids=[9, 9, None, 4, None]).selectExpr("*", "1 AS row", "2 AS near_row", "3 AS node", "4 AS entries")
    rows = N.near_duplicates(df).collect()
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in rows) == sorted(map(str, [(9, 9, 3), (9, 9, 3), (None, 9, 3), (4, 4, 1), (None, None, 1)]))
    left = N.one_of_each(df)
    assert left.columns == df.columns and left.count() == 3
    assert N.near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    got = N.components(edges, spark.range(n + 2).withColumnRenamed("id", "node")).collect()
    assert {r.node: r.label for r in got} == {i: 0 if i < n else i for i in range(n + 2)}


def test_no_link_is_lost_among_close_misses(frame):
    """Groups in which most pairs agree on many entries and few are links: all pairs decide."""
    r = random.Random(11)
    ts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(260)]
        ts += [" ".join(edited(r, base, 5)) for _ in range(120)]
    kmers = [N.labelled_kmers(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in ts]
    label = list(range(len(ts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    sketch = N.sketches(np.concatenate(kmers), np.array([len(x) for x in kmers]))
    short = [(x >> np.uint64(32)).astype(np.uint32) for x in kmers]
    links = misses = 0
    for i in range(len(ts)):
        for j in range(i + 1, len(ts)):
            if (sketch[i] == sketch[j]).sum() >= N.MIN_AGREE:
                if N.aligned_similarity(short[i], short[j]) >= 0.8:
                    a, b = sorted((root(i), root(j)))
                    label[b], links = a, links + 1
                else:
                    misses += 1
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(ts)).collect()}
    assert 0 < 2 * links < misses
    assert got == {i: root(i) for i in range(len(ts))}


def test_columns_hold_only_what_is_known_of_every_row(frame):
    """Links inside a known class are not all verified, so none are counted."""
    assert N.near_duplicates(frame(["a b c", None])).columns == ["doc_id", "row", "class_id", "class_size", "kept"]
