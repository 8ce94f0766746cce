"""Sinks: CSV, fixed-decimal text, per-segment outputs, template alignment."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def fixed_text(v: Column, decimals: int) -> Column:
    """A double as C printf writes it with ``decimals`` places: the exact binary value,
    rounded half to even; NaN and null give null, infinities ``inf`` and ``-inf``.

    The fraction is taken in units of 2**-62 as an integer; bits below only break ties, so
    that digits and remainder follow from exact decimal products.  Whole numbers of 2**62
    and more are put together from two exact parts; from 2**125 on (over 4e37) the
    function raises an error, as a decimal of 38 digits cannot hold them."""
    if not 1 <= decimals <= 17:
        raise ValueError("decimals must be 1 to 17")
    v = v.cast("double")
    size, unit, ten = F.abs(v), 2 ** 62, 10 ** decimals
    dec = lambda n: F.lit(Decimal(n))
    top = F.floor(size / float(unit))
    low = size - top.cast("double") * float(unit)
    whole = F.floor(low)
    scaled = (low - whole.cast("double")) * float(unit)
    grains = F.floor(scaled)
    product = grains.cast("decimal(19,0)") * dec(ten)
    # product = digits * 2**62 + rest
    digits = F.call_function("div", product, dec(unit))
    rest = product % dec(unit)
    below = scaled != grains.cast("double")
    up = (rest > dec(unit // 2)) | ((rest == dec(unit // 2)) & (below | (digits % 2 == 1)))
    digits = digits + up.cast("bigint")
    carry = digits >= ten
    number = top.cast("decimal(19,0)") * dec(unit) + whole.cast("decimal(19,0)") + carry.cast("int").cast("decimal(1,0)")
    text = F.concat(F.when(v.cast("string").startswith("-"), "-").otherwise(""), number.cast("decimal(38,0)").cast("string"), F.lit("."),
                    F.lpad(F.when(carry, digits - ten).otherwise(digits).cast("string"), decimals, "0"))
    return (F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string")).when(size == float("inf"), F.when(v > 0, "inf").otherwise("-inf"))
            .when(size >= float(2 ** 125), F.raise_error(F.lit("a number of 2**125 or more has no exact fixed text")).cast("string"))
            .otherwise(text))


def format_fixed(df: DataFrame, cols: list[str], decimals: int = 4) -> DataFrame:
    """Fixed-decimal text for ``cols`` with correctly rounded binary values
    (C printf semantics, what the reference's ``float_format`` writes).

    Java's ``format_string`` rounds the shortest decimal half-up instead
    (0.03125 -> 0.0313 vs 0.0312), see :func:`fixed_text`."""
    return df.select(*[fixed_text(F.col(c), decimals).alias(c) if c in cols else F.col(c) for c in df.columns])


def write_segments(df: DataFrame, path: str, segment: str, fmt: str = "parquet") -> str:
    """One output folder per segment value (``segment=<v>``), written in one job."""
    df.write.mode("overwrite").partitionBy(segment).format(fmt).save(path)
    return path


def read_segments(spark: SparkSession, path: str, fmt: str = "parquet",
                  segment: str | None = None, value=None) -> DataFrame:
    """Read all segment folders back as one set (partition pruning when a
    segment value is given)."""
    df = spark.read.format(fmt).load(path)
    return df.filter(F.col(segment) == value) if segment is not None and value is not None else df


def align_to_template(template: DataFrame, predictions: DataFrame, key: str = "row_id",
                      value: str = "meter_reading") -> DataFrame:
    """Place predictions on the template's rows by key (never by position);
    template rows without a prediction get NULL."""
    t = template.select(key)
    p = predictions.select(key, F.col(value).alias(value))
    return t.join(p, key, "left")
