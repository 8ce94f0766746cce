"""Merkle manifest of a dataset: one tree per source, one tree over the sources.

A leaf is the SHA-256 of a row's fields (hex digests are what is hashed further up).  In a
source, leaves ascend by id; every ``FAN`` = 16 consecutive nodes become the digest of
their concatenation until one is left, the subroot.  Subroots in the order of the sources
make the root in the same way.

Each level is a table (tree, pos, n, digest) of which ``pos`` gives slot (pos mod 16) and run
(pos div 16).  Lag and lead columns at the fixed offsets 1 to 15, masked by the slot and by the
length of the run, are a node's siblings on either side; the rows of slot 0 hash their own
digest and what leads them to the node above.  A tree that has come down to one node is
handed up as it is, so that all trees reach the top level together.  The way back goes
from the root down: a node's path is its siblings and then its parent's path.

No window and no task holds a source: windows are one run of at most 16 rows, positions come
from ranges of (source, id) with sampled bounds, and only the table of ranges is summed in
order.  A level has a sixteenth of the rows of the one below; a path is at most 15 digests a
level.  To the driver go the row count of the largest source, the number of sources and the
root.

Defined cases: a null field is hashed as ``-``, an empty text as ``0:``; a null source is a
source of its own, before all others; null ids come first in their source and are never
tampered with; rows with the same id are leaves of their own, in the order of their digests
(equal rows are interchangeable); an empty table has no root and gives an empty result;
other columns are ignored, whatever their names; a text is hashed whole, whatever its length
(one row must fit Spark's 2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.llm.common import saved
from wattle.sources.positions import range_rank

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: digests are binary in the tables and hex text only where they are hashed
STEPS = "array<struct<before:binary,after:binary>>"


def _hash_text(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hash_digests(digests: Column) -> Column:
    """Digest of concatenated digests, which count as lower-case hex text."""
    return _hash_text(_hex(digests).cast("binary"))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _nothing() -> Column:
    return F.lit(b"")


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field ``-`` if null, else byte count, ``:`` and value."""
    def coded(c: Column) -> Column:
        v = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return _hash_text(F.concat(*[coded(c) for c in fields]).cast("binary"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, digest, ...) with ``run`` and the digests of the run's other
    nodes: ``before`` and ``after``, concatenated in order."""
    nodes = nodes.withColumn("run", F.floor(F.col("pos") / FAN))
    slot, length = F.pmod("pos", F.lit(FAN)), F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    w = Window.partitionBy("tree", "run").orderBy("pos")

    def at(column: Column, inside: Column) -> Column:
        return F.when(inside, column).otherwise(_nothing())

    before = [at(F.lag("digest", k).over(w), slot >= k) for k in range(FAN - 1, 0, -1)]
    after = [at(F.lead("digest", k).over(w), slot + k < length) for k in range(1, FAN)]
    return nodes.withColumns({"before": F.concat(*before), "after": F.concat(*after)})


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: rows of slot 0 hash their run; the only node of a tree goes up as it is."""
    first = with_siblings(nodes).filter(F.pmod("pos", F.lit(FAN)) == 0)
    digest = F.when(F.col("n") == 1, F.col("digest")).otherwise(_hash_digests(F.concat("digest", "after")))
    return first.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), digest.alias("digest"))


def grow(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """All levels from ``nodes`` up to one node per tree; ``largest`` is the most nodes of a tree."""
    levels = [nodes]
    while largest > 1:
        levels.append(saved(parents(levels[-1]), f"{name}-{len(levels)}"))
        largest = -(-largest // FAN)
    return levels


def descend(levels: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of the lowest level with ``steps`` (siblings per level, from the node up to
    the root of ``top``) and the ``carried`` columns.  ``top`` has them per tree, at pos 0."""
    path = top
    for nodes in levels[-2::-1]:
        up = path.select("tree", F.col("pos").alias("run"), F.col("steps").alias("upper"), *carried)
        own = F.when(F.col("n") == 1, F.array().cast(STEPS)).otherwise(
            F.array(F.struct("before", "after")))
        path = (with_siblings(nodes).join(up, ["tree", "run"])
                .withColumn("steps", F.concat(own, "upper")).drop("run", "before", "after", "upper"))
    return path


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             changed: Column | None = None, changed_fields: list[Column] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, and as binary digests leaf, subroot, root; ``steps`` (the
    siblings per level, before and after) and ``seen``, the leaf of the row as it is found
    now: that of ``changed_fields`` where ``changed`` is true, else the leaf."""
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own = leaf([quote(c) for c in fields])
    seen = F.when(changed, leaf(changed_fields)).otherwise(F.lit(None)) if changed is not None else F.lit(None).cast("binary")
    rows = saved(docs.select(quote(source_col).cast("string").alias("source"), quote(id_col).cast("long").alias("doc_id"),
                             own.alias("digest"), seen.alias("seen"), F.monotonically_increasing_id().alias("row")), "leaves")
    # ``row`` parts equal rows, so that a range can end among them
    ranked = saved(range_rank(rows, ["source", "doc_id", "digest", "row"], "at"), "ranked-leaves")
    # the first position of a source names its tree and keeps the order of the sources
    trees = saved(ranked.groupBy("source").agg(F.min("at").alias("tree"), F.count("*").alias("n")), "trees")
    size = trees.agg(F.max("n").alias("n"), F.count("*").alias("k")).first()
    firsts = trees.withColumnRenamed("source", "of")
    nodes = (ranked.join(firsts, F.col("source").eqNullSafe(F.col("of")))
             .select("tree", (F.col("at") - F.col("tree")).alias("pos"), "n", "digest", "doc_id", "seen"))
    levels = grow(nodes, size["n"] or 0, "level")
    subroots = range_rank(levels[-1].select("tree", "digest"), ["tree"], "pos")
    tops = saved(subroots.select(F.lit(0).cast("long").alias("tree"), "pos", F.lit(size["k"]).cast("long").alias("n"), "digest",
                                 F.col("tree").alias("of")), "subroots")
    upper = grow(tops, size["k"], "upper")
    no_steps = F.array().cast(STEPS)
    root = upper[-1].withColumns({"steps": no_steps, "root": F.col("digest")})
    of = descend(upper, root, ["root"]).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", "root",
                                               F.col("digest").alias("subroot"))
    if len(levels) == 1:                                      # all trees are a lone leaf
        out = levels[0].join(of.drop("pos"), "tree")
    else:
        out = descend(levels, of, ["root", "subroot"])
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps",
                      F.coalesce("seen", "digest").alias("seen"))


def siblings(steps: Column) -> Column:
    """All siblings of a path, level by level, from left to right."""
    return F.aggregate(steps, _nothing(), lambda acc, s: F.concat(acc, s["before"], s["after"]))


def fold(found: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, found, lambda acc, s: _hash_digests(F.concat(s["before"], acc, s["after"])))


def proofs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The proof of every row, checked after one row in five (by the CRC-32 of its id) has
    had its text's A-Z lower-cased: doc_id, leaf, subroot, root and proof_sha256 (untampered),
    folded_root, verified; all digests as hex text."""
    fields = options.pop("fields", FIELDS)
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    tampered = F.crc32(quote(id_col).cast("long").cast("string").cast("binary")) % 5 == 0
    found = [F.translate(quote(c).cast("string"), UPPER, LOWER) if c == text_col else quote(c) for c in fields]
    m = manifest(docs, fields, id_col, changed=tampered, changed_fields=found, **options)
    folded = m.withColumn("folded", fold(F.col("seen"), F.col("steps")))
    return folded.select("doc_id", *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                         F.sha2(_hex(siblings(F.col("steps"))).cast("binary"), 256).alias("proof_sha256"),
                         _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
