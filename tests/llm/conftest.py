"""Small text fixtures for the operators on training text."""

from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or [f"src{i % 3}" for i in range(len(texts))]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]


@pytest.fixture
def frame(spark):
    """Documents from texts (and ids, sources), dealt over a few partitions."""
    def make(texts, ids=None, sources=None, partitions=3):
        return spark.createDataFrame(rows_of(texts, ids, sources), DOC_SCHEMA).repartition(partitions)
    return make


@pytest.fixture
def passages():
    """Texts of several scripts with shared passages, copies, overlaps, nulls and blanks."""
    r = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "Delta", "épsilon", "ζeta", "η", "theta,", "iota.", "a", "of", "the", "東京", "x"]
    word = lambda: r.choice(vocab) + r.choice(["", "", "s", "ing"])
    shared = [" ".join(word() for _ in range(n)) for n in (12, 25, 40, 60, 20, 21)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(shared) if r.random() < 0.35 else " ".join(word() for _ in range(r.randint(1, 40))))
        texts.append(r.choice([" ", "\n", "  ", "\t"]).join(parts))
    texts += [None, "", " \n\t ", "one", texts[3], texts[3], texts[7] + " tail", "head " + texts[9],
              "ab " * 200, "ab " * 120, "z" * 300, "z" * 130, "\x00" * 80 + "q" * 60, "q" * 60 + "\x00" * 70]
    return texts
