"""Substring operators against brute force over every window."""

from __future__ import annotations

import re

import numpy as np
import pytest

from wattle.llm.substring_dedup import substring_dedup
from wattle.llm.suffix_dedup import common_prefixes, least_documents, suffix_array, suffix_dedup
from wattle.llm.repeats import Bucket

SIZES = [{}, {"chunk_bytes": 600, "bucket_bytes": 500}, {"chunk_bytes": 300, "bucket_bytes": 900, "hot_chunks": 2}]


def brute_bytes(rows, width=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if least[b[p:p + width]] < i:
                gone[p:p + width] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def brute_words(rows, width=20):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            least[k] = min(least.get(k, (i, p)), (i, p))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if least[tuple(w[p:p + width])] < (i, p):
                gone[p:p + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for data in (b"", b"a", b"banana", b"z" * 300, b"ab" * 100, bytes(100), bytes(r.integers(0, 3, 2000, np.uint8)),
                 b"x" * 20 + bytes(30) + b"x" * 20 + bytes(9)):
        sa = suffix_array(np.frombuffer(data, np.uint8))
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        lcp = common_prefixes(np.frombuffer(data, np.uint8), sa)
        for k in range(1, len(data)):
            a, b = data[sa[k - 1]:], data[sa[k]:]
            n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


def test_shards_are_merged_by_binary_search():
    r = np.random.default_rng(2)
    texts = list(dict.fromkeys(bytes(r.integers(97, 99, n, np.uint8)) for n in r.integers(8, 40, 80)))
    windows = np.array([len(t) - 7 for t in texts])
    keys = r.integers(0, 50, len(texts))
    bucket = Bucket(texts, windows, keys, np.zeros(len(texts), np.int64))
    whole, _ = least_documents(bucket, 8, 1 << 20)
    parts, _ = least_documents(bucket, 8, 100)
    assert whole.tolist() == parts.tolist()


@pytest.mark.parametrize("sizes", SIZES)
def test_bytes_match_brute_force(frame, passages, sizes):
    got = suffix_dedup(frame(passages), **sizes).collect()
    want = brute_bytes(list(enumerate(passages)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("sizes", SIZES)
def test_words_match_brute_force(frame, passages, sizes):
    got = substring_dedup(frame(passages), **sizes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_words(list(enumerate(passages)))


@pytest.mark.parametrize("op", [suffix_dedup, substring_dedup])
def test_null_ids_repeated_rows_and_clashing_columns(spark, frame, op):
    long = " ".join(f"word{i}" for i in range(40))
    df = frame([long, long, long, None], ids=[5, 5, None, None]).selectExpr("*", "1 AS chunk", "2 AS blob", "3 AS bucket")
    rows = {}
    for r in op(df).collect():
        rows.setdefault(r.doc_id, []).append(r.n_removed)
    assert rows[5] == [0, 0] and sorted(rows[None])[0] == 0 and sorted(rows[None])[1] > 0
    assert op(df.limit(0)).collect() == []


@pytest.mark.parametrize("by_words", [False, True])
def test_surroundings_of_a_passage_do_not_meet_in_one_bucket(frame, by_words):
    """One passage in 2000 texts of two or three chunks, each with its own edges."""
    from wattle.llm import repeats, substring_dedup as W, suffix_dedup as S
    passage = " ".join(f"common{i}" for i in range(30))
    ts = [" ".join([*[f"{i}h{j}" for j in range(20)], passage, *[f"{i}t{j}" for j in range(20)]]) for i in range(2000)]

    def find(bucket):
        assert len(bucket.texts) < 1000
        return W.extend_seeds(bucket) if by_words else S.least_documents(bucket)

    m, spec = (W, repeats.Spec(True, 20, 10, True)) if by_words else (S, repeats.Spec(False, 50, 18, False))
    sizes = {"bucket_bytes": 20_000} | ({"hot_contexts": 200} if hasattr(repeats, "HOT_CONTEXTS") else {})
    got = repeats.run(spec, frame(ts), find, m._emit, m.SCHEMA, m.ARROW, **sizes).collect()
    assert len(got) == 2000
    assert all((r.n_removed >= (30 if by_words else len(passage))) == (r.doc_id > 0) for r in got)


def test_contexts_are_counted_for_hot_anchors(frame, passages):
    """Every anchor with two contexts or more goes by window: same results."""
    got = suffix_dedup(frame(passages), chunk_bytes=3000, bucket_bytes=500, hot_contexts=1).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(list(enumerate(passages)))
    got = substring_dedup(frame(passages), chunk_bytes=3000, bucket_bytes=500, hot_contexts=1).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_words(list(enumerate(passages)))


@pytest.mark.parametrize("op,brute", [(suffix_dedup, brute_bytes), (substring_dedup, brute_words)])
def test_a_chunk_sends_a_blob_for_a_group_of_buckets(frame, passages, monkeypatch, op, brute):
    """Many buckets in two groups: two blobs at most from each chunk, same results."""
    from wattle.llm import repeats
    monkeypatch.setattr(repeats, "GROUPS", 2, raising=False)
    written, saved = {}, repeats.saved
    monkeypatch.setattr(repeats, "saved", lambda df, name: written.setdefault(name, saved(df, name)))
    got = op(frame(passages), chunk_bytes=3000, bucket_bytes=200).collect()
    assert sorted((*r[:-1], bytes(r.kept) if op is suffix_dedup else r.kept) for r in got) == brute(list(enumerate(passages)))
    assert 0 < written["anchors"].count() <= 2 * written["chunks"].count()
    assert repeats.deal(100 << 30, repeats.BUCKET_BYTES).groups < (100 << 30) // (16 << 20)


def test_suffix_arrays_hold_repeated_stretches_only(monkeypatch):
    from wattle.llm import suffix_dedup as S
    r = np.random.default_rng(3)
    once = [bytes(r.integers(97, 123, 200, np.uint8)) for _ in range(50)]
    texts = [*once, once[7][20:100] + b"!", b"?" + once[7][10:90], bytes(60)]
    bucket = Bucket(texts, np.array([len(t) - 49 for t in texts]), np.arange(len(texts))[::-1].copy(), np.zeros(len(texts), np.int64))
    seen, make = [], S.suffix_array
    monkeypatch.setattr(S, "suffix_array", lambda data: seen.append(len(data)) or make(data))
    key, start = S.least_documents(bucket)
    least = {}
    for t, k in zip(texts, bucket.doc_key.tolist(), strict=True):
        for p in range(len(t) - 49):
            least[t[p:p + 50]] = min(least.get(t[p:p + 50], k), k)
    assert key.tolist() == [least[t[p:p + 50]] for t in texts for p in range(len(t) - 49)]
    assert not start.any() and 0 < sum(seen) < 400
