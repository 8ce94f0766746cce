"""Leaf-wise (best-first) histogram boosting for squared error, for a whole fleet at once.

Rows are coded into bins, packed into blocks of numpy columns by segment and written
(:func:`pack`; several fleets can grow on the same blocks).  Every
model of the fleet (a segment, the fold that it leaves out, a set of parameters) grows its
next tree in the same Spark jobs: a job sends (model, parent) histograms of gradient sums and
counts per (feature, bin), summed by Spark; the sibling comes by subtraction from the parent's
histogram, and the best split of both children is searched in the same group.  The driver sees
splits only, never a row.  Where the histograms of the whole fleet are few (``DRIVER_BYTES``,
counted; their size does not depend on the rows) they are summed and searched in the driver
instead, by the same function: a round is then one stage.

Best-first growth splits, of all leaves, the one of highest gain, until there are
``num_leaves``.  A leaf's best split does not depend on the other leaves, so a round opens
all leaves that may still be chosen, and the choice is replayed from the known gains until it
meets a leaf that is not yet open: the tree is the same as one split at a time, in about as
many rounds as the tree is deep.  Rounds do not grow with the number of models.

Trees grown since the blocks were written (at most ``KEEP_TREES``) are applied on the fly, to
the rows that a round needs; then the blocks are written anew with the score of each of their
models and the old ones removed, so a lost executor costs a re-read.  The rows of the left-out fold give the
validation error with the first histogram of the next tree; a model stops after ``patience``
trees without a better one, and its best number of trees is used.

Sums are taken in the order of the partitions: a fit is repeatable for its seed, data layout
and number of partitions.  Rows without a label are left out; NULL features have a bin of
their own that goes to the better side; categories split by sets of codes.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.operators.binning import Bins, fit_bins
from wattle.operators.flat_trees import BROADCAST_BYTES, Boosted, Tree, scores
from wattle.session import remove_table, scratch_path, ship_package

#: trees applied on the fly before the blocks are written anew
KEEP_TREES = 10
BLOCK_ROWS = 16_384
#: bytes of histograms that a task gathers before it sends them on
TASK_BYTES = 256 << 20
#: histograms that may be in the driver at a time, all tasks' counted; beyond, they stay in Spark
DRIVER_BYTES = 512 << 20
#: pulls the mean gradient of a category towards 0 when categories are put in order
CATEGORY_SMOOTHING = 10.0


@dataclass(frozen=True)
class LeafwiseParams:
    """Up to ``n_rounds`` trees of at most ``num_leaves`` leaves, fewer when ``patience`` trees
    bring nothing; ``max_depth`` 0 is no bound."""
    num_leaves: int = 31
    max_depth: int = 0
    learning_rate: float = 0.1
    n_rounds: int = 100
    patience: int = 50
    lambda_l2: float = 1.0
    min_child_weight: float = 1e-3
    min_data_in_leaf: int = 20
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    bagging_freq: int = 1
    seed: int = 4534


@dataclass
class _Node:
    gain: float
    feature: int
    goes_left: bytes
    grad: float
    n: float
    n_left: float
    depth: int = 0
    children: tuple[int, int] | None = None     # opened: the numbers of both


@dataclass
class _Growth:
    """A model while it is fitted."""
    key: tuple
    segment: str
    fold: int | None
    slot: int                                   # its score in the blocks of its segment
    params: LeafwiseParams
    base: float
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    nodes: list[_Node | None] = field(default_factory=list)
    depth_of: dict[int, int] = field(default_factory=dict)
    done: bool = False

    def choose(self) -> tuple[list[int], list[int]]:
        """(leaves to open, chosen splits): none to open when the tree is complete."""
        heap, chosen, leaves = [], [], 1

        def push(i: int) -> None:
            n = self.nodes[i]
            if n.feature >= 0 and not 0 < self.params.max_depth <= n.depth:
                heapq.heappush(heap, (-n.gain, i))

        push(0)
        while heap and leaves < self.params.num_leaves:
            i = heap[0][1]
            if self.nodes[i].children is None:
                closed = [j for _, j in sorted(heap) if self.nodes[j].children is None]
                return closed[:self.params.num_leaves - leaves], chosen
            heapq.heappop(heap)
            chosen.append(i)
            leaves += 1
            for j in self.nodes[i].children:
                push(j)
        return [], chosen

    def tree(self, chosen: list[int], shrink: float | None = None) -> Tree:
        """The chosen splits as a tree, children after their parent."""
        rate = self.params.learning_rate if shrink is None else shrink
        inside, order = set(chosen), [0]
        for i in order:
            if i in inside:
                order += self.nodes[i].children
        at = {j: k for k, j in enumerate(order)}
        node = [self.nodes[j] for j in order]
        split = [j in inside for j in order]
        child = lambda side: np.array([at[n.children[side]] if s else 0 for n, s in zip(node, split, strict=True)], np.int32)
        return Tree(np.array([n.feature if s else -1 for n, s in zip(node, split, strict=True)], np.int32),
                    np.array([np.frombuffer(n.goes_left if s else bytes(32), np.uint8) for n, s in zip(node, split, strict=True)]),
                    child(0), child(1), np.array([-rate * n.grad / (n.n + self.params.lambda_l2) if n.n else 0.0 for n in node]),
                    np.array([n.gain if s else 0.0 for n, s in zip(node, split, strict=True)]))


@dataclass
class Fleet:
    """Fitted models and what is needed to apply them."""
    models: dict[tuple, Boosted]                # (segment, fold, point) -> model
    bins: Bins
    segment: str | None
    fold: str | None
    rounds: int                                 # Spark jobs that grew the trees

    def _scores(self, df: DataFrame, keys: list[tuple], limit: int):
        of = F.coalesce(F.col(self.segment).cast("string"), F.lit("")) if self.segment else None
        return scores(df.sparkSession, [self.models[k] for k in keys], self.bins,
                      [k[0] if self.segment else None for k in keys], of, limit)

    def predict(self, df: DataFrame, name: str = "prediction", log_space: bool | None = None, clip: bool = False,
                limit: int = BROADCAST_BYTES) -> DataFrame:
        """``df`` with the mean of all models of the row's segment: of their raw scores, or for
        log1p targets after (``log_space`` False) or before (True) ``expm1``; NULL for a segment
        without a model."""
        tmp = "__leafwise_scores"
        own = F.filter(F.col(tmp), lambda x: x.isNotNull())
        per = F.transform(own, lambda x: F.expm1(x)) if log_space is False else own
        mean = F.when(F.size(per) > 0, F.aggregate(per, F.lit(0.0), lambda a, x: a + x) / F.size(per))
        mean = F.expm1(mean) if log_space else mean
        mean = F.greatest(mean, F.lit(0.0)) if clip else mean
        return df.withColumn(tmp, self._scores(df, list(self.models), limit)).withColumn(name, mean).drop(tmp)

    def out_of_fold(self, df: DataFrame, name: str = "oof", limit: int = BROADCAST_BYTES) -> DataFrame:
        """``df`` with the score by the model of the row's segment that left out its fold."""
        tmp, keys = "__leafwise_scores", list(self.models)
        at = F.col(self.fold)
        own = [F.when(at == k[1], F.col(tmp)[i]) for i, k in enumerate(keys)]
        return df.withColumn(tmp, self._scores(df, keys, limit)).withColumn(name, F.coalesce(*own)).drop(tmp)

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): total gain of the splits in use, over all models, normalised."""
        gain = np.zeros(len(self.bins.features))
        for m in self.models.values():
            for t in m.used:
                np.add.at(gain, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        gain = gain / gain.sum() if gain.sum() > 0 else gain
        return spark.createDataFrame([(f, float(g)) for f, g in zip(self.bins.features, gain, strict=True)],
                                          "feature string, importance double")


# ---------------------------------------------------------------- blocks

BLOCK = "segment string, n int, codes binary, label binary, fold binary, noise binary, score binary"


def _pack(bins: Bins):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(bins.features))]
            seg = np.array(batch.column("segment").to_pylist(), dtype=object)
            codes, y = bins.codes(x), batch.column("label").to_numpy(zero_copy_only=False)
            fold, noise = batch.column("fold").to_numpy(), batch.column("noise").to_numpy()
            rows = []
            for s in dict.fromkeys(seg):
                m = np.flatnonzero(seg == s)
                rows.append((s, len(m), np.ascontiguousarray(codes[:, m]).tobytes(), y[m].tobytes(), fold[m].astype(np.int32).tobytes(),
                             noise[m].astype(np.uint64, copy=False).tobytes(), b""))        # no score yet: the base
            if rows:
                yield _block_batch(rows)
    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["segment", "n", "codes", "label", "fold", "noise", "score"])


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int):
    for batch in batches:
        for r in batch.to_pylist():
            yield (r, np.frombuffer(r["codes"], np.uint8).reshape(n_features, r["n"]), np.frombuffer(r["label"], np.float64),
                   np.frombuffer(r["fold"], np.int32), np.frombuffer(r["noise"], np.uint64),
                   np.frombuffer(r["score"], np.float64).reshape(-1, r["n"]))


def _rewrite(plan, bases: dict[str, list[float]], n_features: int):
    """Blocks whose scores (``bases`` of the segment's models at first) have the pending trees added."""
    def run(batches):
        for r, codes, *_, score in _blocks(batches, n_features):
            new = score.copy() if len(score) else np.repeat(np.array(bases[r["segment"]])[:, None], r["n"], axis=1)
            for m in plan.value.get(r["segment"], ()):
                for t in m["pending"]:
                    new[m["slot"]] += t.value[t.leaf_of(codes)]
            r["score"] = new.tobytes()
            yield _block_batch([tuple(r.values())])
    return run


def _share(noise: np.ndarray, salt: int, fraction: float) -> np.ndarray:
    """Rows of a random share, the same whenever the salt is."""
    x = noise ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < fraction


# ---------------------------------------------------------------- histograms and splits

PARTIAL = "model int, parent int, part long, cells binary, grad binary, count binary, error double, held double"
COLUMNS = ["model", "node", "grad", "n", "gain", "feature", "goes_left", "n_left", "error", "held", "hist"]
FOUND = ("model int, node int, grad double, n double, gain double, feature int, goes_left binary, n_left double, "
         "error double, held double, hist binary")


def _partials(plan, n_features: int, width: int):
    """Histograms of a task: per model the smaller children of the parents to open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sums: dict[int, np.ndarray] = {}
        errors: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        models = {m["model"]: m for ms in plan.value.values() for m in ms}

        def send() -> Iterator[pa.RecordBatch]:
            rows = []
            for k, h in sums.items():
                for parent, (g, n) in zip(models[k]["parents"], h, strict=True):
                    cells = np.flatnonzero(n)
                    rows.append((k, parent, part, cells.astype(np.int32).tobytes(), g[cells].tobytes(), n[cells].tobytes(), *errors.get(k, (0.0, 0.0))))
            sums.clear()
            errors.clear()
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["model", "parent", "part", "cells", "grad", "count", "error", "held"])

        for r, codes, y, fold, noise, score in _blocks(batches, n_features):
            for m in plan.value.get(r["segment"], ()):
                def grads(rows: np.ndarray) -> np.ndarray:
                    f = score[m["slot"], rows] if len(score) else np.full(len(rows), m["base"])
                    for t in m["pending"]:
                        f += t.value[t.leaf_of(codes, rows)]
                    return f - y[rows]

                train = np.ones(r["n"], bool)
                if m["fold"] is not None:
                    train = fold != m["fold"]
                    if m["parents"] == [-1]:
                        held = np.flatnonzero(~train)
                        errors[m["model"]][0] += float((grads(held) ** 2).sum())
                        errors[m["model"]][1] += float(len(held))
                if m["bag"] is not None:
                    train = train & _share(noise, *m["bag"])
                rows = np.flatnonzero(train)
                s = np.zeros(len(rows), np.int64)
                if m["tree"] is not None:                       # the rows of the children, of all
                    slot = m["place"][m["tree"].leaf_of(codes, rows)]
                    rows, s = rows[slot >= 0], slot[slot >= 0].astype(np.int64) * width
                g, size = grads(rows), len(m["parents"]) * width
                h = sums.setdefault(m["model"], np.zeros((len(m["parents"]), 2, n_features, width)))
                for i in m["features"]:
                    cell = s + codes[i][rows]
                    h[:, 0, i] += np.bincount(cell, g, size).reshape(-1, width)
                    h[:, 1, i] += np.bincount(cell, minlength=size).reshape(-1, width)
            if sum(h.nbytes for h in sums.values()) > TASK_BYTES:
                for h in sums:
                    sums[h] = sums[h].reshape(*sums[h].shape[:2], -1)
                yield from send()
        for h in sums:
            sums[h] = sums[h].reshape(*sums[h].shape[:2], -1)
        yield from send()
    return run


def best_split(hist: np.ndarray, nominal: np.ndarray, l2: float, min_n: float, min_weight: float) -> tuple[float, int, bytes, float]:
    """(gain, feature, codes that go left as bits, rows that go left) of the best split of a
    histogram (2, features, width); feature -1 where none is allowed and better than no split."""
    g, n = hist
    live = np.flatnonzero(n.sum(axis=1) > 0)
    if not len(live):
        return 0.0, -1, bytes(32), 0.0
    total_g, total_n = g[live[0]].sum(), n[live[0]].sum()
    least = max(min_n, min_weight, 1.0)
    width = g.shape[1]
    # order of the codes of each feature: by value, categories by their mean gradient; code 0 (NULL) apart
    order = np.tile(np.arange(1, width), (len(live), 1))
    cats = np.flatnonzero(nominal[live])
    if len(cats):
        mean = np.where(n[live[cats], 1:] > 0, g[live[cats], 1:] / (n[live[cats], 1:] + CATEGORY_SMOOTHING), np.inf)
        order[cats] = np.argsort(mean, axis=1, kind="stable") + 1
    at = live[:, None], order
    cg, cn = np.cumsum(g[at], axis=1), np.cumsum(n[at], axis=1)
    best = (1e-12, -1, bytes(32), 0.0)
    for null_left in (False, True):
        lg, ln = (cg + g[live, :1], cn + n[live, :1]) if null_left else (cg, cn)
        rg, rn = total_g - lg, total_n - ln
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = lg**2 / (ln + l2) + rg**2 / (rn + l2) - total_g**2 / (total_n + l2)
        gain = np.where((ln >= least) & (rn >= least), gain, -np.inf)
        k = int(gain.argmax())
        i, j = divmod(k, gain.shape[1])
        if gain[i, j] > best[0] * (1 + 1e-12):
            left = np.zeros(256, np.uint8)
            left[order[i, :j + 1]] = 1
            left[0] = null_left
            best = float(gain[i, j]), int(live[i]), np.packbits(left, bitorder="little").tobytes(), float(ln[i, j])
    return best


def _children(m: dict, of: int, sent: list[dict], whole: np.ndarray | None, nominal: np.ndarray, width: int):
    """(node, best split and sums, histogram) of both children of a leaf, or of the root: what
    the tasks sent of the smaller child is summed, the sibling is the rest of ``whole``."""
    n_features = len(nominal)
    hist, error, held = np.zeros((2, n_features * width)), 0.0, 0.0
    for r in sorted(sent, key=lambda r: r["part"]):
        cells = np.frombuffer(r["cells"], np.int32)
        hist[0, cells] += np.frombuffer(r["grad"], np.float64)
        hist[1, cells] += np.frombuffer(r["count"], np.float64)
        error, held = error + r["error"], held + r["held"]
    found = [(0, hist)]
    if of != -1:
        small, large = m["opened"][of]
        other = whole - hist
        other[0, other[1] <= 0] = 0.0                           # no rows: what is left is rounding
        found = [(small, hist), (large, other)]
    for node, h in found:
        live = np.flatnonzero(h[1].reshape(n_features, width).sum(axis=1) > 0)
        g, n = (float(h[j].reshape(n_features, width)[live[0]].sum()) if len(live) else 0.0 for j in (0, 1))
        yield (node, g, n, *best_split(h.reshape(2, n_features, width), nominal, *m["limits"]), error, held, h)


def _search(plan, nominal: np.ndarray, width: int):
    """The same for one group of a Spark job."""
    def run(key: tuple, sent: pa.Table, parent: pa.Table | None = None) -> pa.Table:
        model, of = key[0].as_py(), key[1].as_py()
        whole = None if of == -1 else np.frombuffer(parent.column("hist")[0].as_py(), np.float64).reshape(2, -1)
        rows = [(model, *x[:-1], x[-1].tobytes()) for x in _children(plan.value[model], of, sent.to_pylist(), whole, nominal, width)]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(),
                 pa.float64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)
    return run


class _InSpark:
    """Histograms stay in the executors, persisted for the length of a tree: the sums, the
    subtraction and the search are groups of a job, and only splits reach the driver."""

    def __init__(self, bins: Bins):
        self.bins, self.kept = bins, []

    def round(self, sent: DataFrame, by_model: dict, todo: dict) -> list[tuple]:
        plan = sent.sparkSession.sparkContext.broadcast(by_model)
        search, groups = _search(plan, self.bins.nominal, self.bins.width), sent.groupBy("model", "parent")
        if not self.kept:
            found = groups.applyInArrow(lambda key, t: search(key, t), FOUND)
        else:
            wanted = F.concat_ws(":", "model", "node").isin([f"{i}:{p}" for i, ps in todo.items() for p in ps])
            before = reduce(DataFrame.unionByName, self.kept).filter(wanted)
            parents = before.select("model", F.col("node").alias("parent"), "hist").groupBy("model", "parent")
            found = groups.cogroup(parents).applyInArrow(lambda key, t, p: search(key, t, p), FOUND)
        self.kept.append(found.persist(StorageLevel.MEMORY_AND_DISK))
        return [tuple(r) for r in found.drop("hist").collect()]

    def close(self) -> None:
        for k in self.kept:
            k.unpersist()


class _AtDriver:
    """For fleets whose histograms are few: what the tasks send is summed and searched in the
    driver, by the same function, and a round is a job of one stage."""

    def __init__(self, bins: Bins):
        self.bins, self.kept = bins, {}

    def round(self, sent: DataFrame, by_model: dict, todo: dict) -> list[tuple]:
        groups = defaultdict(list)
        for r in sent.collect():
            groups[r["model"], r["parent"]].append(r)
        out = []
        for (i, of), rows in sorted(groups.items()):
            for x in _children(by_model[i], of, rows, self.kept.pop((i, of), None), self.bins.nominal, self.bins.width):
                self.kept[i, x[0]] = x[-1]
                out.append((i, *x[:-1]))
        return out

    def close(self) -> None:
        self.kept.clear()


# ---------------------------------------------------------------- growth

@dataclass(frozen=True)
class Packed:
    """Written blocks of a table, without scores, and the label's (sum, rows) by segment and fold."""
    path: str
    bins: Bins
    features: tuple[str, ...]
    segment: str | None
    fold: str | None
    sums: dict[str, dict[int, tuple]]


def pack(df: DataFrame, features: list[str], label: str, segment: str | None = None, fold: str | None = None,
         categories: dict[str, int] | None = None, max_bins: int = 63, bins: Bins | None = None) -> Packed:
    """The rows of ``df`` in blocks, for any number of fleets; ``remove_table`` its path after
    the last.  ``df`` should be a written table: it is read three times."""
    spark = df.sparkSession
    ship_package(spark)
    known = df.filter(F.col(label).isNotNull())
    bins = bins or fit_bins(known, features, categories, max_bins)
    rows = known.select(
        (F.coalesce(F.col(segment).cast("string"), F.lit("")) if segment else F.lit("")).alias("segment"), F.col(label).cast("double").alias("label"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
        F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("noise"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    # one row per (segment, fold): the base scores
    sums: dict[str, dict[int, tuple]] = defaultdict(dict)
    for r in rows.groupBy("segment", "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n")).orderBy("segment", "fold").collect():
        sums[r["segment"]][r["fold"]] = (r["s"], r["n"])
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n_parts, "segment", F.pmod("noise", F.lit(n_parts))).sortWithinPartitions("segment", "noise")
    with _batches(spark, BLOCK_ROWS):
        path = _written(dealt.mapInArrow(_pack(bins), BLOCK), "blocks")
    return Packed(path, bins, tuple(features), segment, fold, dict(sums))


def train_fleet(df: DataFrame, features: list[str], label: str, segment: str | None = None, fold: str | None = None,
                params: LeafwiseParams | list[LeafwiseParams] | None = None, categories: dict[str, int] | None = None,
                max_bins: int = 63, bins: Bins | None = None, driver_bytes: int = DRIVER_BYTES) -> Fleet:
    """One model per value of ``segment``, per value of ``fold`` (integers; the model leaves
    its rows out and stops early on them) and per set of parameters, all grown together.
    ``df`` should be a written table: it is read three times."""
    packed = pack(df, features, label, segment, fold, categories, max_bins, bins)
    fleet = grow_fleet(df.sparkSession, packed, params, driver_bytes)
    remove_table(df.sparkSession, packed.path)
    return fleet


def grow_fleet(spark: SparkSession, packed: Packed, params: LeafwiseParams | list[LeafwiseParams] | None = None,
               driver_bytes: int = DRIVER_BYTES) -> Fleet:
    """The same on rows that have been packed; the blocks at ``packed.path`` stay as they are."""
    points = [params or LeafwiseParams()] if not isinstance(params, list) else params
    features, bins, segment, fold = packed.features, packed.bins, packed.segment, packed.fold
    fleet: list[_Growth] = []
    bases: dict[str, list[float]] = {}
    for s, by_fold in packed.sums.items():
        bases[s] = []
        for p, q in enumerate(points):
            for k in (by_fold if fold else [None]):
                others = [v for j, v in by_fold.items() if j != k]
                n = sum(v[1] for v in others)
                base = sum(v[0] for v in others) / n if n else 0.0
                fleet.append(_Growth((s, k, p), s, k, len(bases[s]), q, base, done=n == 0))
                bases[s].append(base)
    if not fleet:
        return Fleet({}, bins, segment, fold, 0)
    path, rounds, tree_no, flushed = packed.path, 0, 0, 0
    with _batches(spark, 4):
        blocks = spark.read.schema(BLOCK).parquet(path)
        few = sum(2 * m.params.num_leaves for m in fleet) * 16 * len(features) * bins.width * blocks.rdd.getNumPartitions() <= driver_bytes
        while any(not m.done for m in fleet):
            rounds += _grow_tree(blocks, fleet, bins, tree_no, flushed, (_AtDriver if few else _InSpark)(bins))
            tree_no += 1
            if tree_no - flushed >= KEEP_TREES:
                live = [m for m in fleet if not m.done]
                if live:
                    plan = spark.sparkContext.broadcast(_by_segment(live, flushed))
                    new = _written(blocks.filter(F.col("segment").isin(sorted({m.segment for m in live})))
                                   .mapInArrow(_rewrite(plan, bases, len(features)), BLOCK), "blocks")
                    if path != packed.path:
                        remove_table(spark, path)
                    path, flushed = new, tree_no
                    blocks = spark.read.schema(BLOCK).parquet(path)
    if path != packed.path:
        remove_table(spark, path)
    models = {m.key: Boosted(m.key, m.base, m.trees, _best(m), m.history) for m in fleet}
    return Fleet(models, bins, segment, fold, rounds)


def _best(m: _Growth) -> int:
    return int(np.argmin(m.history)) if m.fold is not None and m.history else len(m.trees)


def _written(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


class _batches:
    """Arrow batches of ``n`` rows while the blocks are made or read."""

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark, n: int):
        self.spark, self.n = spark, n

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, str(self.n))

    def __exit__(self, *_):
        self.spark.conf.set(self.KEY, self.before)


def _by_segment(models: list[_Growth], flushed: int) -> dict[str, list[dict]]:
    out = defaultdict(list)
    for m in models:
        out[m.segment].append({"slot": m.slot, "pending": m.trees[flushed:]})
    return dict(out)


def _grow_tree(blocks: DataFrame, fleet: list[_Growth], bins: Bins, tree_no: int, flushed: int, place_of) -> int:
    """The next tree of every model that is not done; returns the number of rounds."""
    spark = blocks.sparkSession
    live = {i: m for i, m in enumerate(fleet) if not m.done}
    used = {}
    for i, m in live.items():
        m.nodes = []
        rng = np.random.Generator(np.random.PCG64([m.params.seed, tree_no]))
        k = max(1, round(m.params.feature_fraction * len(bins.features)))
        used[i] = np.sort(rng.choice(len(bins.features), k, replace=False)).tolist()
    todo = {i: [-1] for i in live}
    rounds = 0
    while todo:
        by_segment, by_model = defaultdict(list), {}
        for i, parents in todo.items():
            m, q = live[i], live[i].params
            opened, tree, place = {}, None, None
            if parents != [-1]:
                tree, place = _opening(m, parents, opened)
            bag = (q.seed * 1_000_003 + tree_no // max(1, q.bagging_freq), q.bagging_fraction) if q.bagging_fraction < 1 and q.bagging_freq else None
            by_segment[m.segment].append({"model": i, "slot": m.slot, "base": m.base, "pending": m.trees[flushed:], "fold": m.fold, "parents": parents,
                                          "bag": bag, "tree": tree, "place": place, "features": used[i]})
            by_model[i] = {"opened": opened, "limits": (q.lambda_l2, q.min_data_in_leaf, q.min_child_weight)}
        rows_plan = spark.sparkContext.broadcast(dict(by_segment))
        some = blocks if len(by_segment) == len({m.segment for m in fleet}) else blocks.filter(F.col("segment").isin(sorted(by_segment)))
        sent = some.mapInArrow(_partials(rows_plan, len(bins.features), bins.width), PARTIAL)
        rounds += 1
        seen = set()
        for i, at, grad, n, gain, feature, left, n_left, error, held in place_of.round(sent, by_model, todo):
            m = live[i]
            seen.add(i)
            node = _Node(gain, feature, bytes(left), grad, n, n_left)
            if at == 0:
                m.nodes = [node]
                if m.fold is not None:
                    m.history.append(float(np.sqrt(error / held)) if held else float("nan"))
            else:
                node.depth = m.depth_of[at]
                m.nodes[at] = node
        for i in [i for i in todo if i not in seen]:            # a round without rows
            live[i].done = True
        if rounds == 1:
            for i in list(todo):
                if live[i].done or _stops(live[i]):
                    live[i].done = True
                    todo.pop(i)
        todo = {i: opened for i in todo if not live[i].done and (opened := live[i].choose()[0])}
    for m in live.values():
        if not m.done:
            m.trees.append(m.tree(m.choose()[1]))
            m.done = m.fold is None and len(m.trees) >= m.params.n_rounds
    place_of.close()
    return rounds


def _stops(m: _Growth) -> bool:
    """After its last error is known: no better one for ``patience`` trees, or all trees grown."""
    return m.fold is not None and (len(m.trees) >= m.params.n_rounds or len(m.history) - 1 - int(np.argmin(m.history)) >= m.params.patience)


def _opening(m: _Growth, parents: list[int], opened: dict) -> tuple[Tree, np.ndarray]:
    """Numbers the children of the leaves to open; the tree of all opened splits and, for
    its nodes, the place of the histogram that their rows go to (-1: none)."""
    for p in parents:
        n, at = m.nodes[p], len(m.nodes)
        n.children = (at, at + 1)
        m.nodes += [None, None]
        m.depth_of |= {at: n.depth + 1, at + 1: n.depth + 1}
        opened[p] = n.children if n.n_left * 2 <= n.n else (at + 1, at)      # the smaller one first
    number: list[int] = [0]
    for i in number:
        if m.nodes[i] is not None and m.nodes[i].children:
            number += m.nodes[i].children
    blank = _Node(0.0, -1, bytes(32), 0.0, 0.0, 0.0)
    whole = replace(m, nodes=[x or blank for x in m.nodes])
    tree = whole.tree([i for i in number if whole.nodes[i].children])
    place = np.full(len(number), -1, np.int32)
    for k, p in enumerate(parents):
        place[number.index(opened[p][0])] = k
    return tree, place

