"""Toxicity: features by hand, held-out accuracy on labelled texts, defined cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattle.llm import toxicity as X

BAD = ["dreckling", "vermaz", "smorf"]


def matrix(texts, words=("dreckling",)):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    keys = X._hash_words(list(words))
    return X.feature_matrix(data, offs, X.Lexicon(keys, np.full(len(keys), 2.0)))


def test_features_by_hand():
    m = matrix(["you are a Dreckling, DRECKLING!", "", "a dr3ckling and a dreckl1ng here", "far from you a b c d e f g dreckling", "ÉCOLE été"])
    assert m[0, 0] == pytest.approx(4 / 5) and m[0, 1] == pytest.approx(np.log(3)) and m[0, 2] == pytest.approx(2 / 5)
    assert m[0, 4] == 2 and m[0, 5] == pytest.approx(np.log(2)) and m[0, 6] == pytest.approx((3 + 2) / 5 / 2)
    assert m[0, 8] == pytest.approx(1 / 5) and m[0, 10] == pytest.approx(1 / 31)
    assert not m[1].any()
    assert m[2, 1] == 0 and m[2, 11] == pytest.approx(2 / 6) and m[2, 12] == pytest.approx(2 / 6)
    assert m[3, 6] == 0 and m[3, 1] == pytest.approx(np.log(2))
    assert m[4, 14] == pytest.approx(np.log(3))
    again = matrix(["ÉCOLE été"], ["école"])
    assert again[0, 1] == pytest.approx(np.log(2))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    vocab = [f"wort{i}" for i in range(300)] + ["you", "the", "du"]
    docs, labels = [], []
    for i in range(1500):
        w = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        toxic = r.random() < 0.2
        for _ in range(r.randint(2, 5) if toxic else 0):
            b = r.choice(BAD)
            w.insert(r.randint(0, len(w)), b.upper() if r.random() < 0.2 else b + r.choice(["", "en", "ung"]) if b != "smorf" else b)
        docs.append((i, " ".join(w), "x"))
        if r.random() < 0.8:
            labels.append((i, int(toxic)))
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, "you " * 30000 + "smorf dreckling", "x"), (None, "smorf dreckling vermaz", "x")]
    labels += [(3, None), (None, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, p string").selectExpr("*", "1 AS score", "2 AS tox_score", "3 AS tox_features").repartition(3),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_held_out_accuracy_and_calibration(labelled):
    docs, labels, truth = labelled
    model = X.train(docs, labels)
    plain = docs.drop("score")
    got = {r.doc_id: r.score for r in X.score(plain, model).collect()}
    held = [(got[i], y) for i, y in truth.items() if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 150
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    assert np.mean([(s - y) ** 2 for s, y in held]) < 0.03
    assert all(0 <= s <= 1 for s in got.values()) and got[None] >= 0.5 and got[5000] == got[5001] < 0.5
    left = X.without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, s in got.items() if s < 0.5}


def test_held_out_rows_teach_nothing(spark, labelled):
    docs, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.train(docs, labels), X.train(docs, flipped)
    assert a.lexicon.keys.tolist() == b.lexicon.keys.tolist()
    assert a.trees.toDebugString.split("\n", 1)[1] == b.trees.toDebugString.split("\n", 1)[1]


def test_without_both_classes_and_empty_tables(labelled):
    docs, labels, _ = labelled
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        model = X.train(docs, few)
        assert model.trees is None and {r.score for r in X.score(docs.drop("score").limit(5), model).collect()} == {0.0}
    model = X.train(docs.limit(0), labels)
    assert X.score(docs.drop("score").limit(0), model).collect() == [] and model.prior == 0.0
