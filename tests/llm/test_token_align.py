"""Cross-tokenizer alignment against a plain overlap of token byte ranges."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from wattle.llm import perfect_hash
from wattle.llm import token_align as T
from wattle.llm.token_groups import SEGMENT, byte_of_char

TEXTS = ["The quick brown fox, jumps over the lazy dog.", "naïve café — 東京 タワー", "a  b   c\n\n  d\t e \n", " leading", "trailing  ", "\n", " ", "\x1c \x85 x\x1cy !\x1c!",
         "tab\tand nbsp  em", "text with ▁ inside", "<|endoftext|> and <s> </s> <unk> <0x41>", "don't we'll I'VE 1234567 3.14159 x_y", "🙂🙃 emoji é combining",
         "\x00nul\x00", "x" * 3000, "word " * 4000, "def f(x):\n    return x  # comment\n", "ΩΩΩ ≈ç√∫˜µ", "https://a.b/c?d=e&f=g", "a​b ﻿c", None, "", "same same", "same same", "same"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{T.FOLDER}/{T.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{T.FOLDER}/{T.B_FILE}")


def brute(texts, tools):
    a, b = tools
    char, name = byte_of_char(), {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}
    a_bytes = lambda i: bytes(char[c] for c in name[i])

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs, holders = [], defaultdict(set)
    for n, t in enumerate(texts):
        links, groups, ids = [], [], ([], [])
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            cut = [[(k, sum(w[:j]), sum(w[:j + 1])) for j, k in enumerate(x)] if len(x) < 400 else None
                   for x, w in ((ids[0], [len(a_bytes(k)) for k in ids[0]]), (ids[1], [len(b_bytes(k)) for k in ids[1]]))]
            if None in cut:                                                # long: running sums
                cut = []
                for x, size in ((ids[0], a_bytes), (ids[1], b_bytes)):
                    ends = np.cumsum([len(size(k)) for k in x]).tolist()
                    cut.append([(k, e - len(size(k)), e) for k, e in zip(x, ends, strict=True)])
            whole = (" " + t).encode()
            if b"".join(map(a_bytes, ids[0])) == whole == b"".join(map(b_bytes, ids[1])):
                lo = 0
                for e in sorted({x[2] for x in cut[0]} & {x[2] for x in cut[1]}):
                    inside = [[x for x in c if lo <= x[1] and x[2] <= e] for c in cut] if len(whole) < 4000 else None
                    if inside is None:
                        break
                    groups.append("|".join(",".join(str(x[0]) for x in c) for c in inside))
                    links += [(x[0], y[0]) for x in inside[0] for y in inside[1] if x[1] < y[2] and y[1] < x[2]]
                    lo = e
                if len(whole) >= 4000:
                    ends = [sorted(x[2] for x in c) for c in cut]
                    both = sorted(set(ends[0]) & set(ends[1]))
                    i = j = 0
                    for e in both:
                        x, y = [], []
                        while i < len(cut[0]) and cut[0][i][2] <= e:
                            x.append(cut[0][i])
                            i += 1
                        while j < len(cut[1]) and cut[1][j][2] <= e:
                            y.append(cut[1][j])
                            j += 1
                        groups.append(",".join(str(k[0]) for k in x) + "|" + ",".join(str(k[0]) for k in y))
                        links += [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
            else:
                ids = [], []
        docs.append((ids, groups, links))
        for x in links:
            holders[x].add(n)
    count = {k: len(v) for k, v in holders.items()}
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    return [(len(i[0]), len(i[1]), len(g), len(k), sum(count[x] == best[x[0]] for x in k), sum(count[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if i[0] else "") for i, g, k in docs]


@pytest.mark.parametrize("slice_bytes", [T.SLICE_BYTES, 1])
def test_equals_brute_force(spark, tools, slice_bytes, monkeypatch):
    texts = TEXTS if slice_bytes > 1 else TEXTS[:8] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, shard int, keys string").repartition(3)
    if slice_bytes == 1:
        monkeypatch.setattr(T, "slices", lambda index, limit: [list(range(k, T.SHARDS, 3)) for k in range(3)])
    got = {r.doc_id: tuple(r)[1:] for r in T.align(df, slice_bytes=slice_bytes).collect()}
    assert got == dict(enumerate(brute(texts, tools)))


def test_null_ids_repeated_ids_and_empty_table(spark, tools):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r)[1:] for r in T.align(df).collect()))
    assert got == sorted(brute(["one two", "one two", "one", None], tools))
    assert T.align(df.limit(0)).collect() == []
    assert {tuple(r)[1:] for r in T.align(df.filter("text is null")).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_slices_are_bounded(spark):
    rows = [(s, b"", b"x" * 10, b"y" * 40, b"z" * 40) for s in range(9)]
    index = spark.createDataFrame(rows, "shard int, sizes binary, words binary, slots binary, vector binary")
    assert T.slices(index, 300) == [[0, 1], [2, 3], [4, 5], [6, 7], [8]]
    assert T.slices(index, 1) == [[s] for s in range(9)]
    assert T.slices(index.limit(0), 1) == [[]]


def test_counts_up_a_tree(spark, monkeypatch):
    """Blobs of 150 tasks: united, hashed and summed over three levels."""
    r = np.random.default_rng(1)
    rows, want = [], defaultdict(int)
    for part in range(150):
        k = np.unique(r.integers(0, 400, 40)).astype(np.uint64)
        c = r.integers(1, 9, len(k)).astype(np.int64)
        for x, y in zip(k.tolist(), c.tolist(), strict=True):
            want[x] += y
        for s in range(3):
            m = k % 3 == s
            rows.append((s, part, k[m].tobytes(), c[m].tobytes()))
    pairs = spark.createDataFrame(rows, T.BLOBS)
    got = {}
    for row in T.pair_counts(pairs).collect():
        got |= dict(zip(np.frombuffer(row.slots, np.uint64).tolist(), np.frombuffer(row.vector, np.int64).tolist(), strict=True))
    assert got == want


def test_perfect_hash():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 1000, 200_000):
        keys = np.unique(r.integers(0, 2**63, n + 5, dtype=np.uint64))[:n]
        h = perfect_hash.build(keys)
        assert sorted(h.index(keys).tolist()) == list(range(n))
        assert h.words.nbytes * 8 <= 5 * n + 64 * 20                      # bits
    with pytest.raises(ValueError):
        perfect_hash.build(np.zeros(2, np.uint64))


def test_segments_rebuild_the_text_and_cut_only_before_spaces():
    for t in TEXTS:
        if t:
            parts = SEGMENT.findall(" " + t)
            assert "".join(parts) == " " + t
            assert all(p.startswith(" ") and not q[-1].isspace() for q, p in zip(parts, parts[1:], strict=False))
