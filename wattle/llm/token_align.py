"""Cross-tokenizer alignment with corpus-wide counts of linked token pairs.

Every text is encoded by tokenizers A and B; where the byte ranges of two tokens overlap they
are linked.  The count of a pair of ids is the number of documents that hold it linked.

First pass: each task aligns its documents and writes its distinct pairs with their document
counts, one blob for each of ``SHARDS`` shards (by the A id, so that all pairs of an A id are
in one shard).  The distinct pairs of a shard are united up a tree and given a minimal
perfect hash; its keys are kept in hash order, for verification.  Then every group of tasks
adds its counts into a dense vector indexed by the hash, and the vectors are summed up a tree.
Second pass: the documents are aligned again and every link is looked up by its hash, the key
verified, in the shards' vectors.

Size of the vectors: 8 to 16 bytes for each distinct pair, of which there are at most
|A| x |B| however large the corpus (and in practice a small part of that).  They are
broadcast in slices of at most ``SLICE_BYTES``, measured before; if one slice does not hold
them, the second pass is repeated per slice and adds to the sums of the one before, so that
nothing is left out and no task holds more than a slice.  The driver sees one slice at a time,
never anything of a document.

Defined cases: null and empty texts, and texts whose bytes A or B does not give back, have no
tokens: zeros and an empty ``groups``; ids may be null or repeat, every row is a document of its own;
an empty table gives an empty result; other columns are ignored, whatever their names; a very
long text is encoded segment by segment, its memory a multiple of its length (a row and its
groups must fit 2 GB each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.llm import perfect_hash
from wattle.llm.arrays import U64, mix
from wattle.llm.common import id_and_text, saved, tune
from wattle.llm.token_groups import Segments, Vocabularies, distinct, text_sums

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 128
#: blobs that one task of a tree unites or sums, at least
FAN = 64
SLICE_BYTES = 64 << 20
#: distinct pairs that a task of the first pass gathers before it writes them out
FLUSH = 4_000_000

BLOBS = "shard int, part long, keys binary, counts binary"


def _u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _i64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def shard_of(keys: np.ndarray, size_b: int) -> np.ndarray:
    return (mix(keys // U64(size_b)) % U64(SHARDS)).astype(np.int32)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x.decode("utf-8", "replace") if x else "" for x in batch.column("text").to_pylist()]


def document_pairs(seg: Segments, texts: list[str]) -> np.ndarray:
    """The distinct link keys of each text, all texts one after the other."""
    nums, offs = seg.of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offs)).astype(np.uint64)
    once = distinct(doc << U64(40) | nums.astype(np.uint64))             # a segment counts once per text
    keys, n = seg.links_of((once & U64((1 << 40) - 1)).astype(np.int64))
    doc = np.repeat(once >> U64(40), n)
    if len(keys) and int(keys.max()) >> 44:
        raise ValueError("the product of the vocabularies is beyond 2**44")
    return distinct(doc << U64(44) | keys) & U64((1 << 44) - 1)


def _gather(files) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabularies(*files.value)
        seg, size_b, part = Segments(voc), len(voc.b_len), TaskContext.get().partitionId()
        keys, counts, held = [], [], 0

        def blobs() -> pa.RecordBatch:
            k, c = add_up(keys, counts)
            s = shard_of(k, size_b)
            order = np.argsort(s, kind="stable")
            k, c, s = k[order], c[order], s[order]
            cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(s))
            return pa.RecordBatch.from_arrays(
                [pa.array(s[cut], pa.int32()), pa.array([part] * len(cut), pa.int64()),
                 pa.array([k[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary()),
                 pa.array([c[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary())], ["shard", "part", "keys", "counts"])

        for batch in batches:
            k = document_pairs(seg, _texts(batch))
            k, c = add_up([k], [np.ones(len(k), np.int64)])
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > FLUSH:
                k, c = add_up(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > FLUSH // 2:
                    yield blobs()
                    keys, counts, held = [], [], 0
        if held:
            yield blobs()

    return run


def _unite(key: tuple, table: pa.Table) -> pa.Table:
    keys = distinct(np.concatenate([_u64(x) for x in table.column("keys").to_pylist()]))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                     "keys": pa.array([keys.tobytes()], pa.binary())})


def _hash(key: tuple, table: pa.Table) -> pa.Table:
    keys = distinct(np.concatenate([_u64(x) for x in table.column("keys").to_pylist()]))
    h = perfect_hash.build(keys)
    slots = np.empty(len(keys), np.uint64)
    slots[h.index(keys)] = keys
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([h.sizes.tobytes()], pa.binary()),
                     "words": pa.array([h.words.tobytes()], pa.binary()), "slots": pa.array([slots.tobytes()], pa.binary())})


CHANGED = "a pair is not in the index: the documents have changed between the passes"


def _slots_of(h: perfect_hash.PerfectHash, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, verified against the key kept there; -1 for one that was not built in."""
    at = h.index(keys)
    if len(slots):
        at[slots[at] != keys] = -1
    return at


def _dense(key: tuple, blobs: pa.Table, index: pa.Table) -> pa.Table:
    """The counts of a group of tasks as one vector in hash order."""
    row = index.slice(0, 1).to_pylist()[0] if index.num_rows else None
    vector = np.zeros(0, np.int64)
    if row:
        h, slots = perfect_hash.PerfectHash(_i64(row["sizes"]), _u64(row["words"])), _u64(row["slots"])
        vector = np.zeros(len(slots), np.int64)
        for k, c in zip(blobs.column("keys").to_pylist(), blobs.column("counts").to_pylist(), strict=True):
            at = _slots_of(h, slots, _u64(k))
            if (at < 0).any():
                raise ValueError(CHANGED)
            vector[at] += _i64(c)                                          # a blob's keys are distinct
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                     "vector": pa.array([vector.tobytes()], pa.binary())})


def _sum(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(_i64(x) for x in table.column("vector").to_pylist())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                     "vector": pa.array([total.tobytes()], pa.binary())})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(shard, sizes, words, slots, vector) from the blobs of the first pass: the perfect hash
    of a shard, its keys and their document counts in hash order."""
    top = pairs.agg(F.max("part")).first()[0]
    fan = max(FAN, isqrt((top or 0) + 1) + 1)
    group = F.floor(F.col("part") / fan).cast("long")
    united = pairs.select("shard", group.alias("part"), "keys")
    if (top or 0) >= fan:
        united = united.groupBy("shard", "part").applyInArrow(_unite, "shard int, part long, keys binary")
    index = saved(united.groupBy("shard").applyInArrow(_hash, "shard int, sizes binary, words binary, slots binary"), "pair-index")
    groups = pairs.select("shard", group.alias("part")).distinct()
    copies = index.join(groups, "shard").groupBy("shard", "part")
    vectors = (pairs.withColumn("part", group).groupBy("shard", "part").cogroup(copies)
               .applyInArrow(_dense, "shard int, part long, vector binary"))
    while (top := (top or 0) // fan) > 0:
        vectors = (vectors.withColumn("part", F.floor(F.col("part") / fan).cast("long")).groupBy("shard", "part")
                   .applyInArrow(_sum, "shard int, part long, vector binary"))
    return saved(index.join(vectors.drop("part"), "shard"), "pair-counts")


class Lookup:
    """The index rows of some shards: counts of keys, and whether a key's count is the
    highest of its A id."""

    def __init__(self, rows: list[dict], size_b: int):
        self.size_b, self.shards = size_b, {}
        for r in rows:
            slots, vector = _u64(r["slots"]), _i64(r["vector"])
            a = (slots // U64(size_b)).astype(np.int64)
            high = np.zeros(int(a.max()) + 1, np.int64)
            np.maximum.at(high, a, vector)
            self.shards[r["shard"]] = (perfect_hash.PerfectHash(_i64(r["sizes"]), _u64(r["words"])), slots, vector, high[a] == vector)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """(best, count, missing) per key; zeros for keys of other shards."""
        out = np.zeros((len(keys), 3), np.int64)
        shard = shard_of(keys, self.size_b)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        for s, (h, slots, vector, best) in self.shards.items():
            mine = order[cut[s]:cut[s + 1]]
            at = _slots_of(h, slots, keys[mine])
            there = at >= 0
            out[mine[there], 0], out[mine[there], 1] = best[at[there]], vector[at[there]]
            out[mine, 2] = ~there
        return out


COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def _look_up(files, rows, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabularies(*files.value)
        table, seg = Lookup(rows.value, len(voc.b_len)), Segments(voc, texts=last)
        sums, generation = np.zeros((0, 3), np.int64), 0
        for batch in batches:
            nums, offs = seg.of(_texts(batch))
            known = seg.known
            if seg.generation != generation:
                sums, generation = np.zeros((0, 3), np.int64), seg.generation
            done = len(sums)
            if done < len(known.n):                                         # segments that are new
                found = table.of(known.links[known.offs[done]:])
                sums = np.concatenate([sums, text_sums(found, known.offs[done:] - known.offs[done])])
            n_links = np.diff(known.offs)
            per = text_sums(np.concatenate([known.n[nums], n_links[nums, None], sums[nums]], axis=1), offs)
            if per[:, 6].any():                                             # segments of texts without tokens may be missing
                raise ValueError(CHANGED)
            best = per[:, 4] + batch.column("n_best").to_numpy()
            count = per[:, 5] + batch.column("count_sum").to_numpy()
            if last:
                groups = [";".join(map(known.groups.__getitem__, nums[lo:hi].tolist())) for lo, hi in zip(offs, offs[1:], strict=False)]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                cols = [batch.column("doc_id"), *(pa.array(per[:, j]) for j in range(4)), pa.array(best), pa.array(count), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(best), pa.array(count)],
                                                 ["doc_id", "text", "n_best", "count_sum"])
    return run


def slices(index: DataFrame, limit: int) -> list[list[int]]:
    """The shards, in groups of at most ``limit`` bytes as they lie in a task's memory (a
    larger shard is a group by itself)."""
    size = 2 * F.length("vector") + F.length("slots") + F.length("words")
    out, room = [], 0
    for r in index.select("shard", size.alias("size")).orderBy("shard").collect():       # SHARDS rows at most
        if not out or r["size"] > room:
            out.append([])
            room = limit
        out[-1].append(r["shard"])
        room -= r["size"]
    return out or [[]]


def align(docs: DataFrame, a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}", id_col: str = "doc_id",
          text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has
    the highest count of its A id), count_sum (over links) and groups_sha256."""
    spark: SparkSession = docs.sparkSession
    tune(spark)
    files = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))    # vocabulary files: a few MB
    texts = id_and_text(docs, id_col, text_col)
    index = pair_counts(saved(texts.select("text").mapInArrow(_gather(files), BLOBS), "pairs"))
    out = texts.select("doc_id", "text", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    parts = slices(index, slice_bytes)
    for k, shards in enumerate(parts):
        rows = [r.asDict() for r in index.filter(F.col("shard").isin(shards)).collect()] if shards else []
        last = k + 1 == len(parts)
        schema = (f"doc_id long, {COUNTS}, n_best long, count_sum long, groups_sha256 string" if last
                  else "doc_id long, text binary, n_best long, count_sum long")
        out = out.mapInArrow(_look_up(files, spark.sparkContext.broadcast(rows), last), schema)
        out = out if last else saved(out, f"looked-up-{k}")
    return out
