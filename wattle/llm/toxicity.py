"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

* Lexicon: words and word stems (their first 4 or 5 bytes) that occur in clearly more
  toxic than other documents of the training sample (G-squared test).
* Features of a text: lexicon densities (hits in all, weighted, distinct, largest
  weight; stems; hits that appear only after undoing character substitutions), how near
  second-person words stand to the hits, rates of capitals, punctuation, exclamation and
  obfuscation, and length.
* Model: MLlib's boosted trees on those features, then MLlib's isotonic regression from
  the trees' probability to the share of toxic documents.

Training rows: the labelled documents that are not held out, at most ``SAMPLE`` of them,
chosen by the hash of their id.  By another hash they are dealt into three parts: two
learn a lexicon each and give the trees their rows, each with the features of the other
one's lexicon, and the third calibrates, so no row judges its own evidence.  Scores use
the lexicon of the first two parts together.
Every document is scored on its whole text.

Defined cases: null and empty texts get the score of a text without any word; labels are
taken as toxic if any label row of an id says so, null labels are ignored; without both
classes among the training rows every score is the share of toxic rows (0 if there are
none); a null id is never held out and never labelled; empty tables work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm import arrays as A
from wattle.llm.common import bounded_sample, fresh, quoted, saved, tune

SAMPLE = 20_000
LEXICON = 4_096
MIN_G2 = 16.0
MIN_SHARE = 0.75                 # of the documents with an entry that are toxic
STEMS = (4, 5)
NEAR = 5                         # words
TREES, DEPTH, STEP = 20, 4, 0.25
#: fixed values: words that address the reader, in the four languages of the corpus
SECOND_PERSON = ("you your yours yourself du dich dir dein deine ihr euch sie ihnen tu te toi ton ta vous votre vos "
                 "tú usted ustedes ti tus vosotros os").split()
#: fixed values: characters that stand in for letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

ALNUM = ~A.NOT_ALNUM
ALNUM[65:91] = True
SYMBOL = A.byte_set(r"@$!*")
UPPER = A.byte_set("A-Z")
LETTER = A.byte_set("A-Za-z")
PUNCT = A.byte_set(r"!-/:-@\[-`{-~")
DIGIT = A.byte_set("0-9")
UNDO = A.LOWER.copy()
for _c, _to in SUBSTITUTES.items():
    UNDO[ord(_c)] = ord(_to)


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented Latin letters (two bytes, 0xC3 first)."""
    low = A.LOWER[data]
    if len(low) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[second] += 0x20
    return low


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return np.sort(A.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends))


def _entries(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of lower-cased texts: starts, ends, counts and, for whole words and each stem
    length, their hashes (0 for words that are no longer than the stem)."""
    s, e, n = A.word_spans(data, offs, ~ALNUM)
    kinds = [A.span_hashes(data, s, e)]
    for ln in STEMS:
        h = A.span_hashes(data, s, np.minimum(e, s + ln)) ^ A.U64(ln)
        kinds.append(np.where(e - s > ln, h, A.U64(0)))
    return s, e, n, kinds


@dataclass
class Lexicon:
    keys: np.ndarray               # sorted hashes
    weights: np.ndarray            # log odds

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Weight of each hash, 0 if it is no entry."""
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 0.0)


def _sums(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(v, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


N_FEATURES = 16
_second = _hash_words(SECOND_PERSON)


def feature_matrix(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(texts, N_FEATURES)."""
    n_texts = len(offs) - 1
    out = np.zeros((n_texts, N_FEATURES))
    if len(data) == 0:
        return out
    low = _lower(data)
    s, e, n, kinds = _entries(low, offs)
    at = np.concatenate([[0], np.cumsum(n)])
    words = np.maximum(n, 1)
    whole, *stems = [lexicon.look_up(h) for h in kinds]
    stem = np.maximum.reduce(stems) if len(s) else np.zeros(0)
    best = np.maximum(whole, stem)
    hit = best > 0
    out[:, 0] = _sums(best, at) / words
    out[:, 1] = np.log1p(_sums(hit, at))
    out[:, 2] = _sums(whole > 0, at) / words
    out[:, 3] = _sums(stem > 0, at) / words
    place = np.flatnonzero(hit)
    doc = np.searchsorted(at, place, "right") - 1
    np.maximum.at(out[:, 4], doc, best[place])
    if len(place):
        pair = np.unique(np.stack([doc.astype(np.uint64), kinds[0][place]]), axis=1)
        out[:, 5] = np.log1p(np.bincount(pair[0].astype(np.int64), minlength=n_texts))
        you = np.flatnonzero(np.isin(kinds[0], _second))
        if len(you):
            i = np.searchsorted(you, place)
            gap = np.full(len(place), NEAR + 1)
            for j in (np.maximum(i - 1, 0), np.minimum(i, len(you) - 1)):
                same = (np.searchsorted(at, you[j], "right") - 1) == doc
                gap = np.where(same, np.minimum(gap, np.abs(you[j] - place)), gap)
            near = np.zeros(len(s))
            near[place] = np.maximum(NEAR + 1 - gap, 0) / NEAR
            out[:, 6] = _sums(near, at) / np.maximum(_sums(hit, at), 1)
    size = np.maximum(np.diff(offs), 1)
    letters = np.maximum(_sums(LETTER[data], offs), 1)
    out[:, 7] = _sums(UPPER[data], offs) / letters
    if len(s):
        capital = np.add.reduceat(np.append(UPPER[data], False).astype(np.int64), np.stack([s, e], 1).ravel())[::2]
        out[:, 8] = _sums((capital == e - s) & (e - s > 1), at) / words
    out[:, 9] = _sums(PUNCT[data], offs) / size
    out[:, 10] = _sums((data == 33) | (data == 63), offs) / size
    # words with a symbol or digit between letters: undo the substitution and look again
    solid = ALNUM[data]
    inner = np.zeros(len(data), bool)
    inner[1:-1] = SYMBOL[data[1:-1]] & solid[:-2] & solid[2:]
    inner[offs[1:-1][offs[1:-1] < len(data)]] = False
    token = solid | inner
    mark = np.where(token, 97, 32).astype(np.uint8)
    ts, te, tn = A.word_spans(mark, offs, A.SPACES)
    tat = np.concatenate([[0], np.cumsum(tn)])
    if len(ts):
        bounds = np.stack([ts, te], 1).ravel()
        odd = np.add.reduceat(np.append(inner | DIGIT[data], False).astype(np.int64), bounds)[::2]
        alpha = np.add.reduceat(np.append(LETTER[data], False).astype(np.int64), bounds)[::2]
        masked = (odd > 0) & (alpha > 0)
        out[:, 11] = _sums(masked, tat) / words
        m = np.flatnonzero(masked)
        if len(m):
            clear = UNDO[data]
            h = A.span_hashes(clear, ts[m], te[m])
            found = np.zeros(len(ts))
            found[m] = lexicon.look_up(h) > 0
            out[:, 12] = _sums(found, tat) / words
            out[:, 13] = np.log1p(_sums(found, tat))
    out[:, 14] = np.log1p(n)
    out[:, 15] = _sums((e - s).astype(float), at) / words
    return out


def features(text: Column, lexicon: Lexicon) -> Column:
    """Feature array of a text column."""
    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        data, offs = A.arrow_bytes(col)
        m = feature_matrix(data, offs, lexicon)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, N_FEATURES), pa.int32()), pa.array(m.ravel()))

    return run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, n_toxic): documents of the batch that have the entry."""
    for b in batches:
        data, offs = A.arrow_bytes(b.column("text"))
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        _, _, n, kinds = _entries(_lower(data), offs)
        doc = np.tile(np.repeat(np.arange(len(n)), n), len(kinds))
        key = np.concatenate(kinds)
        keep = key != 0
        order = np.lexsort([doc[keep], key[keep]])
        key, doc = key[keep][order], doc[keep][order]
        one = np.ones(len(key), bool)
        one[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[one], doc[one]
        u, at = np.unique(key, return_index=True)
        if len(u):
            yield pa.RecordBatch.from_pydict({"key": pa.array(u.view(np.int64)), "n": pa.array(np.add.reduceat(np.ones(len(key), np.int64), at)),
                                              "n_toxic": pa.array(np.add.reduceat(toxic[doc], at))})


def learn_lexicon(texts: DataFrame, limit: int = LEXICON) -> Lexicon:
    """From rows (text binary, toxic int); the driver gets at most ``limit`` entries."""
    n, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    c = texts.select("text", "toxic").mapInArrow(_count_entries, "key long, n long, n_toxic long")
    c = c.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t"))
    p = n_toxic / n
    term = lambda k, share: F.when(k > 0, k * F.log(k / share)).otherwise(0.0)
    clean = F.col("n") - F.col("t")
    c = c.withColumn("g2", 2 * (term(F.col("t"), F.col("n") * p) + term(clean, F.col("n") * (1 - p))))
    rows = (c.filter((F.col("t") >= F.col("n") * max(MIN_SHARE, (1 + p) / 2)) & (F.col("g2") >= MIN_G2))
            .orderBy(F.desc("g2"), "key").limit(limit).collect())
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    weights = np.array([math.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) for r in rows])
    order = np.argsort(keys)
    return Lexicon(keys[order], weights[order])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out."""
    spark = docs.sparkSession
    tune(spark)
    marked = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
              .agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("id"))))
    marked = bounded_sample(marked, sample, "id")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    # the sample is bounded, so its ids and labels may be broadcast
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("id")), F.lit(5))
    rows = saved(d.join(F.broadcast(marked), "id").select("text", "toxic", part.alias("part")), "sample")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = n_toxic / n if n else 0.0
    first, second, last = rows.filter("part < 2"), rows.filter("part IN (2, 3)"), rows.filter("part = 4")
    lexicon = learn_lexicon(rows.filter("part < 4"))
    given = [(first, learn_lexicon(second)), (second, learn_lexicon(first)), (last, lexicon)]
    fit = reduce(DataFrame.unionByName, [r.select("part", F.col("toxic").cast("double").alias("label"),
                                                  array_to_vector(features(F.col("text").cast("string"), lex)).alias("features")) for r, lex in given])
    fit = saved(fit.repartition(4), "features")
    trained, kept_back = fit.filter("part < 4"), fit.filter("part = 4")
    if trained.select("label").distinct().count() < 2 or kept_back.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, prior)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=2).fit(trained)
    judged = trees.transform(kept_back).select("label", vector_to_array("probability")[1].alias("p"))
    return Model(lexicon, trees, IsotonicRegression(featuresCol="p", labelCol="label").fit(judged), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability that a document is toxic."""
    tune(docs.sparkSession)
    text = F.col("`" + text_col.replace("`", "``") + "`")
    if model.trees is None:
        return docs.withColumn(name, F.lit(float(model.prior)))
    v, raw, prob, hard, p = fresh(docs, "tox_features", "tox_raw", "tox_probability", "tox_class", "tox_p")
    trees = model.trees.copy()
    trees.setFeaturesCol(v).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(hard)
    out = trees.transform(docs.withColumn(v, array_to_vector(features(text, model.lexicon))))
    out = out.withColumn(p, vector_to_array(prob)[1])
    calibration = model.calibration.copy()
    calibration.setFeaturesCol(p).setPredictionCol(name)
    out = calibration.transform(out.select(*quoted(docs), p))
    return out.withColumn(name, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0))).drop(p)


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents whose score is ``least`` or more; all columns stay."""
    (name,) = fresh(docs, "tox_score")
    return score(docs, train(docs, labels), name=name).filter(F.col(name) < least).select(*quoted(docs))
