"""Mixing sources to target weights with a low-discrepancy slot schedule.

Targets: the sources in code point order (null last) carry the weights in turn; a target
is the water level times the weight, but never more than ``repeat`` times the words of
its source.  The level solves sum(min(repeat * size, level * weight)) = share * total in
closed form over the sources sorted by size / weight, which is where resharing the
excess until no target is above its bound ends.

Schedule: a source needs ceil(target / block) slots.  Slot ``n`` has the point frac(n *
golden ratio); the source into whose part of the cumulative needs the point falls gets
the slot.  Any part of length p is met again after at most 2.62 / p points, so
``SLOTS_PER_NEED`` = 3 points for each slot that is needed give every source all of its
own; later ones are passed over.  Slots are ranked per source, and slot ``k`` of a source
takes block ``k mod blocks`` of the source's documents, which are laid end to end in
shuffled order and cut into blocks of equal word counts.  The last slot of a source is
cut short, so a source is taken for its target to the word.

Nothing is ranked or summed over a whole source in one task: documents are grouped by
(source, hash range), slots by (source, stretch of the slot number), and only the small
tables of group totals are summed along a source.

Defined cases: null text has size 0; empty or zero-sized sources have target 0 and no
blocks; null is a source like any other; rows with the same id are separate rows; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.llm.common import fresh, quoted, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
#: words of a block
BLOCK = 256
SLOTS_PER_NEED = 3
#: least rows of a (source, hash range) group, on average over all sources; a group has the
#: square root of all rows, so that neither groups nor the tables of groups grow large
GROUP_ROWS = 1_000
#: slot numbers ranked together, and cells of the unit interval for the slot-to-source join
STRETCH = 1 << 16
CELLS = 4096
GOLDEN = "0.618033988749894848"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source_no, source, source_size, target) from rows (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("source_no"), F.lit(len(weights))) + 1)
    s = (by_source.withColumn("source_no", number.cast("int")).withColumn("w", w)
         .withColumn("bound", F.col("source_size") * F.lit(float(repeat))))
    order = Window.orderBy(F.col("bound") / F.col("w"), "source_no")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    s = (s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("free_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero))
         .withColumn("free", F.col("total") - F.coalesce(F.sum("bound").over(before), zero))
         .withColumn("level", F.col("free") / F.col("free_w")))
    # the first source, in this order, that its level does not fill
    fits = F.when(F.col("level") <= F.col("bound") / F.col("w"), F.struct(F.col("bound") / F.col("w"), "source_no", "level"))
    s = s.withColumn("level", F.min(fits).over(everything)["level"])
    return s.select("source_no", "source", "source_size",
                    F.least("bound", F.coalesce(F.col("level") * F.col("w"), F.col("bound"))).alias("target"))


def _slots(spark, tgt: DataFrame, block: int) -> DataFrame:
    """(source_no, block_no, take): the words that a slot takes from the start of a block."""
    words, size = F.floor("target"), F.col("source_size")
    passes = F.when(size > 0, F.floor(words / size)).otherwise(0)
    need = passes * F.ceil(size / block) + F.ceil((words - passes * size) / block)   # the last block of a pass is short
    spans = (tgt.withColumn("need", need).filter("need > 0").withColumn("hi", F.sum("need").over(Window.orderBy("source_no")))
             .withColumn("all", F.sum("need").over(Window.partitionBy())))
    n_slots = SLOTS_PER_NEED * (spans.agg(F.max("all")).first()[0] or 0)
    spans = spans.withColumns({"lo": (F.col("hi") - F.col("need")) / F.col("all"), "hi": F.col("hi") / F.col("all")})
    spans = spans.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    x = F.pmod(F.col("id").cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(18,18)"), F.lit(1).cast("decimal(1,0)")).cast("double")
    slots = spark.range(n_slots).withColumn("x", x).withColumn("cell", F.floor(F.col("x") * CELLS))
    hit = (slots.join(spans, "cell").filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
           .select("id", "source_no", "need", F.floor(F.col("id") / STRETCH).alias("stretch")))
    per = hit.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source_no").orderBy("stretch")
    per = per.withColumn("before", F.sum("n").over(along) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("source_no", "stretch").orderBy("id")) - 1
    ranked = (hit.withColumn("r", rank).join(per, ["source_no", "stretch"])
              .withColumn("r", F.col("r") + F.col("before")).filter("r < need").select("source_no", "r"))
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    s = ranked.join(tgt, "source_no").withColumn("block_no", F.pmod(F.col("r"), blocks))
    done = F.floor(F.col("r") / blocks) * F.col("source_size") + F.col("block_no") * block
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block_no") * block)
    take = F.least(length, F.floor(F.col("target")).cast("long") - done)
    return s.withColumn("take", take).filter("take > 0").select("source_no", "block_no", "take")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK,
            row_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target (of its source) and
    taken (words of it in the mix, repeats counted).  ``row_col`` names a column to carry along."""
    spark = docs.sparkSession
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
               n_words(F.col(text_col).cast("string")).alias("size")]
    columns.append(F.col(row_col).alias("row") if row_col else F.monotonically_increasing_id().alias("row"))
    sized = saved(docs.select(*columns), "sizes")
    tgt = saved(targets(sized, weights, share, repeat).coalesce(1), "targets")
    n_rows = sized.count()
    bits = (n_rows // max(GROUP_ROWS, isqrt(n_rows))).bit_length()
    # shuffled order: by the digest of the id; its leading bits are the hash range
    rows = sized.join(tgt.select(F.col("source").alias("s"), "source_no", "source_size", "target"),
                      F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = (rows.withColumn("digest", digest)
            .withColumn("part", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / F.lit(1 << (32 - min(bits, 32))))))
    per = rows.groupBy("source_no", "part").agg(F.sum("size").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("source_no").orderBy("part")) - F.col("n")).drop("n")
    inside = Window.partitionBy("source_no", "part").orderBy("digest", "doc_id", "size", "row")
    rows = (rows.withColumn("at", F.sum("size").over(inside) - F.col("size"))
            .join(per, ["source_no", "part"]).withColumn("at", F.col("at") + F.col("before")))
    pieces = rows.withColumn("block_no", F.explode(F.when(F.col("size") > 0, F.sequence(
        F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).otherwise(F.array(F.lit(-1).cast("long")))))
    uses = _slots(spark, tgt, block).groupBy("source_no", "block_no").agg(F.collect_list("take").alias("takes"))
    lo = F.greatest(F.col("at") - F.col("block_no") * block, F.lit(0).cast("long"))
    hi = F.col("at") + F.col("size") - F.col("block_no") * block
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.least(hi, t) - lo, F.lit(0).cast("long")))
    return (pieces.join(uses, ["source_no", "block_no"], "left").withColumn("taken", F.coalesce(taken, F.lit(0).cast("long")))
            .groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
                                F.sum("taken").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns and ``taken``, the words that the
    mix takes of each (twice its size for one that is repeated in full)."""
    row, taken = fresh(docs, "mix_row", "taken")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plan = mixture(numbered, row_col=row, **options).filter("taken > 0")
    plan = plan.select(F.col("row").alias(row), F.col("taken").alias(taken))
    return numbered.join(plan, row).select(*quoted(docs), F.col(taken))
