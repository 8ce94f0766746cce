"""Unions and set difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def union_segments(parts: list[DataFrame]) -> DataFrame:
    """Concatenate per-segment results (no shuffle: partitions are appended)."""
    return reduce(union_by_name, parts)


def set_difference(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows of ``a[cols]`` absent from ``b[cols]``."""
    return a.select(*cols).distinct().join(b.select(*cols), cols, "left_anti")
