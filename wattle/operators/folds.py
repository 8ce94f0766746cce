"""Cross-validation fold assignment as a column.

Contiguous folds (KFold / per-class StratifiedKFold without shuffle) follow
``ntile`` semantics: with n rows and k folds, the first n mod k folds hold
one extra row.  Positions come from :func:`dense_position` (bounded-range
windows + prefix sums), never from a window over all rows.  Group folds use
the greedy rule (largest group first, into the lightest fold) in closed form
over the table of distinct group sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.session import scratch_path, write_table
from wattle.sources.positions import dense_position, range_rank

#: sizes with their runs held on the driver before they are written
ASSIGN_BATCH = 100_000


def fold_of(pos: Column, n: Column, k: int) -> Column:
    """Fold index of 0-based position ``pos`` among ``n`` rows in ``k`` contiguous folds."""
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1))).otherwise(
        r + F.floor((pos - big) / F.greatest(q, F.lit(1)))).cast("int")


def folds_kfold(df: DataFrame, k: int, order: str = "row_id", name: str = "fold") -> DataFrame:
    """Contiguous k folds in ``order`` (unique integer key)."""
    p = dense_position(df, order, "__pos", total="__n")
    return p.select(*df.columns, fold_of(F.col("__pos"), F.col("__n"), k).alias(name))


def folds_stratified(df: DataFrame, k: int, label: str, order: str = "row_id",
                     name: str = "fold") -> DataFrame:
    """Per-class contiguous folds (each class split into k runs in ``order``)."""
    p = dense_position(df, order, "__pos", by=[label], total="__n")
    return p.select(*df.columns, fold_of(F.col("__pos"), F.col("__n"), k).alias(name))


def deal_run(load: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """Deal ``count`` groups of one ``size`` greedily into the lightest fold (lowest index
    on ties), in closed form; ``load`` is brought up to date.

    Fold f takes its j-th group of the run at load ``load[f] + j * size``, so the run goes
    through levels of ``size`` rows: at each level the folds that have reached it take one
    group each, in the order of what their load leaves by ``size``.  Returns at most k
    pieces (first, end, folds): the groups first..end-1 of the run go round ``folds``."""
    level = [x // size for x in load]
    order = sorted(range(len(load)), key=lambda f: (load[f] % size, f))
    steps = sorted(set(level))
    pieces, first = [], 0
    for now, after in zip(steps, steps[1:] + [None]):
        if first == count:
            break
        active = [f for f in order if level[f] <= now]
        n = count - first if after is None else min(count - first, (after - now) * len(active))
        for place, f in enumerate(active):
            load[f] += size * (n // len(active) + (place < n % len(active)))
        pieces.append((first, first + n, active))
        first += n
    return pieces


def group_fold_table(df: DataFrame, k: int, group: str, name: str = "fold", batch: int = ASSIGN_BATCH) -> DataFrame:
    """(group, fold) by the greedy rule: groups by size descending (ties: larger
    group value first), each into the currently lightest fold (lowest index on ties).

    The rule is sequential over sizes only: the table of distinct sizes (at most the
    square root of twice the rows) is streamed through the driver, where the groups of a
    size are dealt as a run (:func:`deal_run`); the groups themselves are ranked by Spark
    and look their piece of the run up."""
    spark = df.sparkSession
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__down", -F.col("__n"))
    ranked = range_rank(sizes, ["__down", group], "__rank")
    path = scratch_path(spark, "group-runs")
    schema = "__size long, __before long, __count long, __pieces array<struct<first:long,end:long,folds:array<int>>>"
    load, before, part = [0] * k, 0, []

    def flush() -> None:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        part.clear()

    runs = write_table(ranked.groupBy("__n").agg(F.count(F.lit(1)).alias("__count")), "group-sizes")
    for r in runs.orderBy(F.desc("__n")).toLocalIterator():
        part.append((r["__n"], before, r["__count"], deal_run(load, r["__n"], r["__count"])))
        before += r["__count"]
        if len(part) >= batch:
            flush()
    if before < k:
        raise ValueError(f"cannot split {before} groups into {k} folds")
    flush()
    # no hint: one row per distinct size, sized by the planner from the written table
    dealt = ranked.join(spark.read.schema(schema).parquet(path), F.col("__n") == F.col("__size"))
    place = (F.col("__before") + F.col("__count") - 1 - F.col("__rank")).alias("__place")      # larger group values first
    dealt = dealt.select(group, "__pieces", place)
    piece = F.filter("__pieces", lambda p: (p["first"] <= F.col("__place")) & (F.col("__place") < p["end"]))[0]
    dealt = dealt.select(group, "__place", piece.alias("__piece"))
    turn = ((F.col("__place") - F.col("__piece.first")) % F.size("__piece.folds")).cast("int")
    return dealt.select(group, F.col("__piece.folds")[turn].alias(name))


def folds_group(df: DataFrame, k: int, group: str, name: str = "fold") -> DataFrame:
    table = group_fold_table(df, k, group, name).withColumnRenamed(group, "__g")
    return df.join(table, F.col(group).eqNullSafe(F.col("__g")), "left").select(*df.columns, name)
