"""Projections and schema narrowing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT_TYPES = (T.FloatType, T.DoubleType)

# Integer tiers by strict (exclusive) bounds, then float32 / float64.
INT_TIERS = (("tinyint", -128, 127), ("smallint", -32768, 32767),
             ("int", -2147483648, 2147483647), ("bigint", -9223372036854775808, 9223372036854775807))
FLOAT32_MAX = 3.4028234663852886e38


def project_drop(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def project_except(df: DataFrame, exclude: list[str]) -> DataFrame:
    """Keep every column not in ``exclude`` (feature list by exclusion)."""
    return df.select(*[c for c in df.columns if c not in set(exclude)])


def range_report(df: DataFrame) -> DataFrame:
    """One aggregate pass: min, max and the narrowest type per numeric column.

    Columns: column_name, min_value, max_value, target_type.  An empty or
    all-NULL column keeps its type.
    """
    num = [f for f in df.schema.fields if isinstance(f.dataType, _INT_TYPES + _FLOAT_TYPES)]
    aggs = []
    for f in num:
        aggs += [F.min(f.name).cast("double").alias(f"{f.name}__min"),
                 F.max(f.name).cast("double").alias(f"{f.name}__max")]
    row = df.agg(*aggs)
    parts = []
    for f in num:
        lo, hi = F.col(f"{f.name}__min"), F.col(f"{f.name}__max")
        if isinstance(f.dataType, _INT_TYPES):
            t = None
            for name, a, b in INT_TIERS:
                cond = (lo > F.lit(float(a))) & (hi < F.lit(float(b)))
                t = F.when(cond, F.lit(name)) if t is None else t.when(cond, F.lit(name))
            t = t.otherwise(F.lit(f.dataType.simpleString()))
        else:
            t = (F.when((lo > F.lit(-FLOAT32_MAX)) & (hi < F.lit(FLOAT32_MAX)), F.lit("float"))
                 .otherwise(F.lit("double")))
        t = F.when(lo.isNull(), F.lit(f.dataType.simpleString())).otherwise(t)
        parts.append(F.struct(F.lit(f.name).alias("column_name"), lo.alias("min_value"),
                              hi.alias("max_value"), t.alias("target_type")))
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def narrow_schema(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the narrowest type that holds the observed range
    (one aggregate job; float16 has no Spark type and is not offered)."""
    rep = {r["column_name"]: r["target_type"] for r in range_report(df).collect()}  # one row per column
    return df.select(*[F.col(c).cast(rep[c]).alias(c) if c in rep else F.col(c) for c in df.columns])
