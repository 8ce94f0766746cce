"""Exact dedup by composable polynomial fingerprints.

A text is stripped of ASCII white space and cut into chunks.  The fingerprint of a chunk
is its polynomial at two points modulo each of two 31-bit primes; chunk fingerprints
combine by ``left * point ** len(right) + right``, so the chunks of a huge document are
spread over the cluster and hashed in parallel, and the order of combination is free.

Texts with equal fingerprint and length are compared byte by byte, chunk by chunk,
against the one that stays: a join on (fingerprint, chunk number), so no group is ever
gathered in one task.  Should one fingerprint ever hold different texts, its rows are
grouped by the digest of the text instead.

Defined cases: null counts as empty, and empty (or blank) texts are equal; the row with
the most code points stays, then the smallest id (null last), and of rows equal in both
exactly one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.llm.arrays import SPACES, arrow_bytes
from wattle.llm.common import saved, tune

PRIMES = (2147483647, 2147483629)
POINTS = (1103515245, 1664525013)
CHUNK = 1 << 16                  # bytes hashed in one go: sums of 2**39 terms stay below 2**64
HUGE = 8 << 20                   # bytes from which a document is spread over tasks
PIECE = 1 << 20                  # characters of a spread piece
COMPARE = 1 << 16                # bytes of a compared chunk
MODULI = [(p, x) for p in PRIMES for x in POINTS]

_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """x**i mod p for i < CHUNK, for each modulus."""
    if not _tables:
        for p, x in MODULI:
            t = np.ones(1, np.uint64)
            while len(t) < CHUNK:
                t = np.concatenate([t, t * np.uint64(pow(x, len(t), p)) % np.uint64(p)])
            _tables.append(t)
    return _tables


def combine(left: list[int], right: list[int], right_len: int) -> list[int]:
    """Fingerprint of the concatenation."""
    return [(a * pow(x, right_len, p) + b) % p for a, b, (p, x) in zip(left, right, MODULI, strict=True)]


def fingerprints(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """Fingerprint of every text of a batch."""
    lens = np.diff(offs)
    parts = np.maximum(-(-lens // CHUNK), 1)
    doc = np.repeat(np.arange(len(lens)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offs[:-1][doc] + nth * CHUNK
    size = np.minimum(begin + CHUNK, offs[1:][doc]) - begin
    some = np.flatnonzero(size > 0)
    values = np.zeros((len(MODULI), len(doc)), np.uint64)
    if len(some):
        exp = np.repeat(begin[some] + size[some] - 1, size[some]) - np.arange(len(data))
        at = begin[some]
        letters = data.astype(np.uint64) + np.uint64(1)
        for m, ((p, _), t) in enumerate(zip(MODULI, _powers(), strict=True)):
            values[m, some] = np.add.reduceat(letters * t[exp], at) % np.uint64(p)
    out: list[list[int]] = []
    for d, v, n in zip(doc.tolist(), values.T.tolist(), size.tolist(), strict=True):
        if d == len(out):
            out.append(v)
        else:
            out[d] = combine(out[d], v, n)
    return out


def _strip(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, offs) of the texts without white space, and the code points of the originals."""
    data, offs = arrow_bytes(col)
    keep = ~SPACES[data]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offs], np.diff(points)


def _keys(fps: list[list[int]]) -> tuple[pa.Array, pa.Array]:
    return (pa.array([f[0] << 31 | f[1] for f in fps], pa.int64()), pa.array([f[2] << 31 | f[3] for f in fps], pa.int64()))


FP_SCHEMA = "doc_id long, row long, k1 long, k2 long, n long, points long, sha string"


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs, points = _strip(b.column("text"))
        k1, k2 = _keys(fingerprints(data, offs))
        raw, o = data.tobytes(), offs.tolist()
        sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(o[:-1], o[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), k1, k2, pa.array(np.diff(offs)),
                                          pa.array(points.astype(np.int64)), pa.array(sha, pa.string())],
                                         names=["doc_id", "row", "k1", "k2", "n", "points", "sha"])


PIECE_SCHEMA = "doc_id long, row long, sha string, piece int, f array<long>, n long, points long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs, points = _strip(b.column("text"))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "row", "sha", "piece")], pa.array(fingerprints(data, offs), pa.list_(pa.int64())),
                                          pa.array(np.diff(offs)), pa.array(points.astype(np.int64))],
                                         names=["doc_id", "row", "sha", "piece", "f", "n", "points"])


def _join_pieces(pieces: pa.Table) -> pa.Table:
    """One huge document: its pieces' fingerprints (a few numbers each) in order."""
    total, n = None, 0
    for r in sorted(pieces.select(["piece", "f", "n"]).to_pylist(), key=lambda r: r["piece"]):
        total = r["f"] if total is None else combine(total, r["f"], r["n"])
        n += r["n"]
    k1, k2 = _keys([total])
    one = [pieces.column(c).slice(0, 1).combine_chunks() for c in ("doc_id", "row", "sha")]
    return pa.table({"doc_id": one[0], "row": one[1], "k1": k1, "k2": k2, "n": pa.array([n], pa.int64()),
                     "points": pa.array([sum(pieces.column("points").to_pylist())], pa.int64()), "sha": one[2]})


def _stripped(text):
    return F.translate(text.cast("string"), " \t\n\x0b\x0c\r", "")


def fingerprint_table(docs: DataFrame, huge: int = HUGE, piece: int = PIECE) -> DataFrame:
    """(doc_id, row, k1, k2, n, points, sha) of rows (doc_id, text binary); ``row`` is a
    number of the row."""
    is_huge = F.octet_length("text") > huge
    number = F.monotonically_increasing_id() * 2
    small = docs.filter(~is_huge).withColumn("row", number).mapInArrow(_fingerprint, FP_SCHEMA)
    big = docs.filter(is_huge).withColumn("row", number + 1).withColumn("t", F.col("text").cast("string"))
    cut = F.transform(F.sequence(F.lit(0), (F.length("t") / piece).cast("int")), lambda i: F.col("t").substr(i * piece + 1, F.lit(piece)))
    sha = F.sha2(_stripped(F.col("t")).cast("binary"), 256).alias("sha")
    pieces = (big.select("doc_id", "row", sha, F.posexplode(cut).alias("piece", "text")).repartition("row", "piece")
              .withColumn("text", F.col("text").cast("binary")).mapInArrow(_pieces, PIECE_SCHEMA))
    return small.unionByName(pieces.groupBy("row").applyInArrow(_join_pieces, FP_SCHEMA))


TEXT_SCHEMA = "doc_id long, k1 long, k2 long, n long, points long, part int, chunk binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripped texts in chunks of COMPARE bytes, with the fingerprint that was joined."""
    for b in batches:
        data, offs, _ = _strip(b.column("text"))
        raw, o = data.tobytes(), offs.tolist()
        which, part, chunk = [], [], []
        for i in range(b.num_rows):
            for j, at in enumerate(range(o[i], o[i + 1], COMPARE)):
                which.append(i)
                part.append(j)
                chunk.append(raw[at:min(at + COMPARE, o[i + 1])])
        take = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in ("doc_id", "k1", "k2", "n", "points")],
                                          pa.array(part, pa.int32()), pa.array(chunk, pa.binary())],
                                         names=["doc_id", "k1", "k2", "n", "points", "part", "chunk"])


KEY = ["k1", "k2", "n"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE,
                piece: int = PIECE) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the stripped
    text), n_points and the fingerprint columns k1, k2."""
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    prints = saved(fingerprint_table(rows, huge, piece), "fingerprints")
    best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("best")
    groups = prints.groupBy(*KEY).agg(best, F.count("*").alias("size"))
    # equal fingerprints: compare the members' chunks with those of the row that stays
    shared = saved(groups.filter("size > 1 and n > 0").select(*KEY, F.col("best.doc_id").alias("keep"), (-F.col("best.col1")).alias("keep_points")), "groups")
    members = prints.join(shared, KEY, "left_semi").select("doc_id", "points", *KEY).distinct()
    texts = rows.select("doc_id", "text", F.length(F.col("text").cast("string")).cast("long").alias("p"))
    m = members.withColumnRenamed("doc_id", "id")
    chunks = (texts.join(m, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("p") == F.col("points")))
              .select("doc_id", *KEY, "points", "text").mapInArrow(_cut, TEXT_SCHEMA)).withColumn("chunk_hash", F.xxhash64("chunk"))
    kept = (chunks.join(shared, KEY).filter(F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("points") == F.col("keep_points")))
            .groupBy(*KEY, "part").agg(F.min("chunk").alias("kept_chunk")))
    kept = saved(kept, "kept-chunks")            # a scan of its own: the members' side of the join can be split
    differ = (chunks.join(kept, [*KEY, "part"], "left").filter(~F.col("chunk").eqNullSafe(F.col("kept_chunk")))
              .select(*KEY).distinct().withColumn("split", F.lit(True)))
    prints = prints.join(saved(differ, "differ"), KEY, "left").withColumn("class", F.when(F.col("split"), F.col("sha")))
    groups = prints.groupBy(*KEY, "class").agg(best, F.count("*").alias("group_size"))
    groups = saved(groups, "classes")
    g = groups.select(*[F.col(c).alias(f"g_{c}") for c in KEY], F.col("class").alias("g_class"), "best", "group_size")
    same = [F.col(c) == F.col(f"g_{c}") for c in KEY] + [F.col("class").eqNullSafe(F.col("g_class"))]
    on = same[0] & same[1] & same[2] & same[3]
    return prints.join(g, on).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size"), (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("points").alias("n_points"), "k1", "k2")
