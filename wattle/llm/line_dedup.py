"""Line dedup by distinct-site spread.

Lines (trimmed, all that are not blank) are keyed by two 64-bit hashes.
A HyperLogLog sketch per key counts the distinct sites (the ``source`` column) that show
the line; partial sketches merge by aggregation, so a line that occurs everywhere costs
one small sketch per task, not a row per occurrence.  Lines whose estimate lies within
``BAND`` of the threshold get an exact distinct count; the others are decided by the
estimate (the band is more than nine standard errors of the sketch wide).

A line on ``MIN_SITES`` sites or more is boilerplate and is removed from every document
but the one with the smallest id that has it, so that copies of a document on many sites
lose their lines and the first one keeps them.

Defined cases: null text stays null and has no lines; blank lines always stay; a null
source is one site of its own; a null id sorts last; rows with the same id count as one
document, also where it is the one that keeps a line; an empty table gives an empty
result; all columns of the input are kept; a text of any length that fits a row (2 GB) is
read whole, and what is shuffled of it is a key per distinct line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm.common import fresh, saved

MIN_SITES = 10
#: binary logarithm of the sketch's registers: a standard error of 1.6 %
SKETCH_BITS = 12
BAND = 0.15

BLANKS = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _norm(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    """128 bits of the trimmed line; null for blank lines, which are never removed."""
    n = _norm(line)
    return F.when(n != "", F.struct(F.xxhash64(n).alias("a"), F.xxhash64(F.lit("line"), n).alias("b")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, bits: int = SKETCH_BITS, band: float = BAND) -> DataFrame:
    """(key, sites, owner) of the lines on at least ``min_sites`` sites, from rows
    (key, site, id).  ``sites`` is exact near the threshold and estimated above it."""
    owner = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("owner")
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(bits)).alias("sketch"), owner)
    spread = saved(spread.select("key", F.hll_sketch_estimate("sketch").alias("sites"), "owner")
                   .filter(F.col("sites") >= F.lit(min_sites * (1 - band))), "spread")
    is_near = F.col("sites") < F.lit(min_sites * (1 + band))
    near = spread.filter(is_near).select("key", "owner")
    exact = (lines.select("key", "site").join(near, "key").groupBy("key", "owner")
             .agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites))
    return spread.filter(~is_near).unionByName(exact.select("key", "sites", "owner"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               min_sites: int = MIN_SITES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text column.  ``counts`` names two
    columns to add: the lines of the original text and those removed."""
    gone, ident = fresh(docs, "line_gone", "line_id")
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    lines = docs.select(q(id_col).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), q(source_col).cast("string")), F.lit("")).alias("site"),
                        F.explode(lines_of(q(text_col))).alias("line"))
    lines = saved(lines.select("id", "site", _key(F.col("line")).alias("key")).filter("key IS NOT NULL").distinct(), "lines")
    common = saved(boilerplate(lines, min_sites), "boilerplate")
    hits = (lines.select("id", "key").join(common.select("key", "owner"), "key")
            .filter(~F.col("id").eqNullSafe(F.col("owner.id"))))
    per = hits.groupBy("id").agg(F.collect_set("key").alias(gone)).select(F.col("id").alias(ident), gone)
    out = docs.join(per, q(id_col).cast("long").eqNullSafe(F.col(ident)), "left")
    text = q(text_col)
    keep = F.filter(lines_of(text), lambda x: ~F.coalesce(F.array_contains(F.col(gone), _key(x)), F.lit(False)))
    columns = [F.when(F.col(gone).isNull(), text).otherwise(F.array_join(keep, "\n")).alias(c) if c == text_col else q(c) for c in docs.columns]
    if counts:
        n = F.coalesce(F.size(lines_of(text)), F.lit(0))
        n = F.when(text.isNull(), 0).otherwise(n).cast("long")
        columns += [n.alias(counts[0]), F.when(F.col(gone).isNull(), F.lit(0).cast("long")).otherwise(n - F.size(keep)).alias(counts[1])]
    return out.select(*columns)
