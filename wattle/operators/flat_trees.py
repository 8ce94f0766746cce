"""Fitted trees as flat arrays, evaluated for many models in one vectorised pass.

A tree is five arrays over its nodes: feature (-1 for a leaf), the codes that go left (a bit
each), the child on either side, and the value.  A forest lays the trees of all models end to
end.  Rows are coded once and then walk down all trees together, a numpy step per level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wattle.operators.binning import Bins
from wattle.session import ship_package

#: a forest beyond this many bytes is broadcast and evaluated in parts
BROADCAST_BYTES = 64 << 20
#: rows to a split of a tree from which rows are sent down split by split
ROWS_PER_SPLIT = 64


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray         # int32, -1: leaf
    goes_left: np.ndarray       # (nodes, 32) uint8: one bit per code
    left: np.ndarray            # int32
    right: np.ndarray
    value: np.ndarray           # float64, shrunk
    gain: np.ndarray            # float64, of the split (0 for a leaf)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.feature, self.goes_left, self.left, self.right, self.value))

    def leaf_of(self, codes: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Node in which each column of ``codes`` (features x rows) ends, or each of the
        columns ``rows``.  Where there are many rows to a split, they go down split by split,
        else level by level."""
        n = codes.shape[1] if rows is None else len(rows)
        node = np.zeros(n, np.int32)
        splits = np.flatnonzero(self.feature >= 0)
        if len(splits) * ROWS_PER_SPLIT <= n:
            goes_left = dict(zip(splits.tolist(), np.unpackbits(self.goes_left[splits], axis=1, bitorder="little").view(bool), strict=True))
            todo = [(0, np.arange(n))]
            while todo:
                i, at = todo.pop()
                if (f := self.feature[i]) < 0:
                    node[at] = i
                    continue
                to_left = goes_left[i][codes[f][at if rows is None else rows[at]]]
                todo += [(c, x) for c, x in ((self.left[i], at[to_left]), (self.right[i], at[~to_left])) if len(x)]
            return node
        if rows is not None:
            codes = codes[:, rows]
        open_ = np.flatnonzero(self.feature[node] >= 0)
        while len(open_):
            at = node[open_]
            code = codes[self.feature[at], open_]
            left = (self.goes_left[at, code >> 3] >> (code & 7)) & 1
            node[open_] = at = np.where(left == 1, self.left[at], self.right[at])
            open_ = open_[self.feature[at] >= 0]
        return node


@dataclass
class Boosted:
    """One model: base score plus trees; ``history`` is the validation RMSE before each tree
    and after the last, ``best`` the number of trees in use."""
    key: tuple
    base: float
    trees: list[Tree]
    best: int
    history: list[float]

    @property
    def used(self) -> list[Tree]:
        return self.trees[:self.best]

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(codes.shape[1], self.base)
        for t in self.used:
            out += t.value[t.leaf_of(codes)]
        return out


def parts(models: Sequence[Boosted], limit: int = BROADCAST_BYTES) -> list[list[int]]:
    """Positions of the models in groups of at most ``limit`` bytes (a larger model by itself)."""
    out, room = [], 0
    for i, m in enumerate(models):
        size = sum(t.nbytes for t in m.used)
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room -= size
    return out


def scores(spark: SparkSession, models: Sequence[Boosted], bins: Bins, segments: Sequence, segment: Column | None,
           limit: int = BROADCAST_BYTES) -> Column:
    """array<double>: the raw score by each model, in order, and NULL from those of another
    segment.  ``segments``: the segment of each model; ``segment``: that of a row (text)."""
    ship_package(spark)
    columns = [F.col(f).cast("double") for f in bins.features]
    which = segment if segment is not None else F.lit("")
    out = []
    for group in parts(models, limit):
        shared = spark.sparkContext.broadcast([(segments[i], models[i].base, models[i].used) for i in group])
        out.append(_scorer(shared, bins)(which, *columns))
    return F.concat(*out) if out else F.array().cast("array<double>")


def _scorer(shared, bins: Bins):
    @F.arrow_udf("array<double>")
    def run(which: pa.Array, *columns: pa.Array) -> pa.Array:
        codes = bins.codes([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
        n, of = len(which), np.array(which.to_pylist(), dtype=object)
        total = np.full((n, len(shared.value)), np.nan)
        for s in {x[0] for x in shared.value}:
            rows = np.arange(n) if s is None else np.flatnonzero(of == s)
            mine = codes[:, rows]
            for j, (seg, base, trees) in enumerate(shared.value):
                if seg == s and len(rows):
                    total[rows, j] = Boosted((), base, trees, len(trees), []).raw(mine)
        flat = pa.array(total.ravel(), mask=np.isnan(total.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * total.shape[1]), flat)

    return run
