"""Time-series operators by (site, block of time): no task holds a site's history.

A scan on two levels: rows are ranked inside their block, and one row per block carries
across blocks what the rows need (how many rows came before, the last and next known
values).  Windows of a fixed number of rows get a halo: the few rows at a block's edge are
copied to the blocks whose windows reach them, which may be several where blocks hold fewer
rows than the window.  The results are those of the per-site windows of ``timeseries``.

Defined cases: null sites are one site, rows without a time come first; rows of a site at
one time are ordered by the columns that are worked on; empty tables work.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.operators.timeseries import ROLLING_STATS, lead_features, rolling_stats

#: hours in a block: a year
BLOCK_HOURS = 24 * 366
B, RANK, POS, REAL = "__block", "__rank", "__pos", "__real"


def _ranked(df: DataFrame, order: list[str], site: str, ts: str, hours: int) -> DataFrame:
    start = F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    block = F.floor(F.timestamp_diff("HOUR", start, F.col(ts).cast("timestamp_ntz")) / hours)
    inside = Window.partitionBy(site, B).orderBy(ts, *order)
    return df.withColumn(B, block).withColumn(RANK, F.row_number().over(inside).cast("long") - 1)


def _blocks(ranked: DataFrame, site: str, extra: list[Column] = ()) -> tuple[DataFrame, Window]:
    """One row per (site, block): ``__n`` rows, ``__off`` rows of the site before it, ``extra`` aggregates."""
    per = ranked.groupBy(site, B).agg(F.count(F.lit(1)).alias("__n"), *extra)
    order = Window.partitionBy(site).orderBy(B)
    return per.withColumn("__off", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), order


def _join_blocks(rows: DataFrame, per: DataFrame, site: str) -> DataFrame:
    per = per.withColumnsRenamed({site: "__b_site", B: "__b_block"})
    on = F.col(site).eqNullSafe(F.col("__b_site")) & F.col(B).eqNullSafe(F.col("__b_block"))
    return rows.join(per, on).withColumn(POS, F.col("__off") + F.col(RANK))


def with_halo(df: DataFrame, before: int, after: int, order: list[str], site: str = "site_id", ts: str = "timestamp",
              hours: int = BLOCK_HOURS) -> DataFrame:
    """``df`` with ``__block``, ``__pos`` (place in the site) and ``__real``, and with copies
    (``__real`` false) of the ``before`` rows that precede each block and of the ``after``
    rows that follow it.  A row and its copies come out of one step."""
    ranked = _ranked(df, order, site, ts, hours)
    per, w = _blocks(ranked, site)
    near = F.struct(F.col(B).alias("block"), F.col("__off").alias("off"), (F.col("__off") + F.col("__n") - 1).alias("end"))
    none = F.array().cast("array<struct<block:bigint,off:bigint,end:bigint>>")
    per = per.withColumns({"__later": F.collect_list(near).over(w.rowsBetween(1, before)) if before else none,
                           "__earlier": F.collect_list(near).over(w.rowsBetween(-after, -1)) if after else none})
    rows = _join_blocks(ranked, per, site)
    target = lambda block, real: F.struct(block.alias("block"), F.lit(real).alias("real"))
    later = F.filter(F.when(F.col("__n") - F.col(RANK) <= before, F.col("__later")).otherwise(none), lambda x: x["off"] - F.col(POS) <= before)
    earlier = F.filter(F.when(F.col(RANK) < after, F.col("__earlier")).otherwise(none), lambda x: F.col(POS) - x["end"] <= after)
    targets = F.concat(F.array(target(F.col(B), True)), F.transform(later, lambda x: target(x["block"], False)),
                       F.transform(earlier, lambda x: target(x["block"], False)))
    return (rows.select(*df.columns, POS, F.explode(targets).alias("__t"))
            .select(*df.columns, POS, F.col("__t.block").alias(B), F.col("__t.real").alias(REAL)))


def rolling_stats_blocks(df: DataFrame, cols: list[str], window: int = 18, site: str = "site_id", ts: str = "timestamp",
                         stats=ROLLING_STATS, drop_source: bool = False, hours: int = BLOCK_HOURS) -> DataFrame:
    """:func:`timeseries.rolling_stats` by block, with a halo of ``window`` - 1 rows."""
    halo = with_halo(df, window - 1, 0, cols, site, ts, hours)
    return rolling_stats(halo, cols, window, [site, B], POS, stats, drop_source).filter(REAL).drop(B, POS, REAL)


def lead_features_blocks(df: DataFrame, col: str, steps=(1, 2, 3), site: str = "site_id", ts: str = "timestamp",
                         hours: int = BLOCK_HOURS) -> DataFrame:
    """:func:`timeseries.lead_features` by block, with a halo of as many rows as the largest step."""
    halo = with_halo(df, 0, max(steps), [col], site, ts, hours)
    return lead_features(halo, col, steps, [site, B], POS).filter(REAL).drop(B, POS, REAL)


def interpolate_blocks(df: DataFrame, cols: list[str], site: str = "site_id", ts: str = "timestamp", hours: int = BLOCK_HOURS) -> DataFrame:
    """:func:`timeseries.interpolate_linear` by block: the last known value before a block and
    the first one after it are carried over the table of blocks, with their places."""
    ranked = _ranked(df, cols, site, ts, hours)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(RANK).alias("at"), F.col(c).cast("double").alias("v")))
    edges = [f(known(c)).alias(f"__{name}_{i}") for i, c in enumerate(cols) for name, f in (("first", F.min), ("last", F.max))]
    per, w = _blocks(ranked, site, edges)
    placed = lambda name: F.when(F.col(name).isNotNull(), F.struct((F.col(name)["at"] + F.col("__off")).alias("at"), F.col(name)["v"].alias("v")))
    down = Window.partitionBy(site).orderBy(F.col(B).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    carries = {}
    for i in range(len(cols)):
        carries[f"__before_{i}"] = F.last(placed(f"__last_{i}"), ignorenulls=True).over(up)
        carries[f"__after_{i}"] = F.last(placed(f"__first_{i}"), ignorenulls=True).over(down)
    rows = _join_blocks(ranked, per.withColumns(carries).drop(*[f"__{n}_{i}" for n in ("first", "last") for i in range(len(cols))]), site)
    back = Window.partitionBy(site, B).orderBy(RANK).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(site, B).orderBy(F.col(RANK).desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("at"), F.col(c).cast("double").alias("v")))
    rows = rows.withColumns({f"__p_{i}": F.last(here(c), ignorenulls=True).over(back) for i, c in enumerate(cols)})
    rows = rows.withColumns({f"__q_{i}": F.last(here(c), ignorenulls=True).over(ahead) for i, c in enumerate(cols)})
    out = {}
    for i, c in enumerate(cols):
        p, q = F.coalesce(f"__p_{i}", f"__before_{i}"), F.coalesce(f"__q_{i}", f"__after_{i}")
        line = p["v"] + (q["v"] - p["v"]) * (F.col(POS) - p["at"]) / (q["at"] - p["at"])
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(line)).alias(c)
    return rows.select(*[out.get(c, F.col(c)) for c in df.columns])
