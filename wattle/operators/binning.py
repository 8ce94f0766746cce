"""Feature bins for histogram boosting: at most 255 codes a feature, 0 for NULL.

Numeric features: the distinct values where there are few, else approximate quantiles; code
``i`` holds the values above edge ``i - 2`` up to edge ``i - 1``.  Categories (codes 0 to n - 1): one
code each; codes beyond ``MAX_CODES`` - 2 and unknown ones share the last.  Only the edges, at
most 254 numbers a feature, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CODES = 255


@dataclass(frozen=True)
class Bins:
    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]               # empty for categories
    categories: dict[str, int]                  # feature -> number of values

    @property
    def width(self) -> int:
        """Codes of the widest feature."""
        return max((min(self.categories[f] + 2, MAX_CODES) if f in self.categories else len(e) + 2
                    for f, e in zip(self.features, self.edges, strict=True)), default=1)

    @property
    def nominal(self) -> np.ndarray:
        return np.array([f in self.categories for f in self.features])

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """uint8 codes, one row per feature, of float columns (NaN: NULL)."""
        out = np.zeros((len(self.features), len(columns[0]) if columns else 0), np.uint8)
        for i, (f, e, x) in enumerate(zip(self.features, self.edges, columns, strict=True)):
            there = ~np.isnan(x)
            if f in self.categories:
                last = min(self.categories[f] + 2, MAX_CODES) - 1
                known = there & (x >= 0) & (x < last - 1)
                out[i] = np.where(known, np.where(known, x, 0) + 1, np.where(there, last, 0))
            else:
                out[i] = np.where(there, np.searchsorted(e, np.where(there, x, 0), "left") + 1, 0)
        return out


def fit_bins(df: DataFrame, features: list[str], categories: dict[str, int] | None = None, max_bins: int = 63) -> Bins:
    """Bins of ``features`` (``categories``: feature -> number of values) from all rows, in two aggregates."""
    if not 2 <= max_bins <= MAX_CODES - 1:
        raise ValueError("max_bins is from 2 to 254")
    categories = {f: n for f, n in (categories or {}).items() if f in features}
    numeric = [f for f in features if f not in categories]
    x = {f: F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in numeric}
    edges: dict[str, np.ndarray] = {}
    if numeric:
        n = df.agg(*[F.approx_count_distinct(x[f]).alias(f) for f in numeric]).first()
        few = {f for f in numeric if n[f] <= max_bins}
        probs = [k / max_bins for k in range(1, max_bins)]
        agg = [(F.collect_set(x[f]) if f in few else F.percentile_approx(x[f], probs, 20 * max_bins)).alias(f) for f in numeric]
        row = df.agg(*agg).first()
        for f in numeric:
            values = np.unique(np.array(row[f] or [], np.float64))
            # the last distinct value needs no edge: nothing lies above it
            edges[f] = values[:-1][:MAX_CODES - 2] if f in few else values
    return Bins(tuple(features), tuple(edges.get(f, np.zeros(0)) for f in features), categories)
