"""Near-duplicate documents by Order MinHash with banded alignment.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A text's
k-mers are its runs of ``K`` words (a text of fewer words is one k-mer); each carries its
occurrence number in the text, so a repeated k-mer counts as often as it is repeated.

* Sketch: for each of ``TABLES`` hash functions the ``SAMPLE`` smallest labelled k-mers,
  hashed in the order in which they stand in the text.  Texts agree on an entry with
  about the probability similarity ** SAMPLE; a change of order breaks the agreement.
* Candidates: texts with equal words are one class from the start (one row stands for
  all copies).  First, the members of a bucket (one of the first ``BUCKETS`` entries) are
  paired with its least and its greatest member, by a join whose hot side can be split, and
  the classes are joined.  Then the buckets that still have members of several classes are
  compared in tiles, with no row for a pair: a tile holds the sketches and k-mers of at most
  about ``TILE`` members on each side and is compared inside a task, the pairs that agree
  most first; those found in one class by then are passed over, and a spanning forest of the
  links comes back.  Buckets of up to ``TILE`` members are one tile; larger ones are cut into parts, and
  after these have joined the classes, the members outside a bucket's commonest class meet
  all its members, tile by tile.  A pair is aligned when it shares a bucket, its sketches
  agree on ``MIN_AGREE`` entries and its lengths allow the similarity.
* Verification: labelled k-mers match at most once, so the best alignment of two texts
  is the longest chain of matches that rises in both; matches outside the band of
  diagonals that a similar pair can touch are left out.  Similarity is the length of the
  chain over the k-mers of both texts less the chain (order-aware Jaccard); pairs of
  ``SIMILARITY`` or more are links.
* Classes: connected components of the links, by least labels and pointer jumping on
  tables in the shared folder.

At similarity 0.8 an entry agrees with probability 0.64: fewer than 8 of 32 do with one of
1.4e-6, none of the 16 buckets with one of 8e-8; at 0.4, 13 % of the pairs get that far.  No
other link is lost.  Rows grow with the texts in buckets; a bucket of n members of which m are
outside its commonest class, once parts are joined, is sent as about 2 m n / ``TILE`` rows.

Defined cases: null, empty and wordless texts are alone in their class; the document with
the smallest id stays (null last), of equal ids one row; rows with the same id are
separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm import arrays as A
from wattle.llm.common import fresh, quoted, saved, tune

K = 5
#: entries of a sketch, and those of them that make buckets
TABLES, BUCKETS = 32, 16
SAMPLE = 2
MIN_AGREE = 8
SIMILARITY = 0.8
#: members of a bucket on each side of a tile, and rows of tiles in one group of a job
TILE, GROUP = 1024, 4096
BOTH, LEFT, RIGHT = 0, 1, 2
#: node numbers (8 bytes each) that are broadcast to pick the k-mers of a round
BROADCAST_NODES = 1_000_000
SEEDS = A.mix(np.arange(1, 65, dtype=np.uint64) * A.MULT)


def labelled_kmers(data: np.ndarray, offs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labelled k-mer hashes, their counts by text, word hashes, word counts)."""
    low = A.LOWER[data]
    s, e, n = A.word_spans(low, offs, A.NOT_ALNUM)
    word = A.span_hashes(low, s, e)
    at = np.cumsum(n) - n
    full = np.maximum(n - k + 1, 0)
    h = A.gram_hashes(word, k)
    own = A.ranges(at, full)
    short = np.flatnonzero((n > 0) & (n < k))
    counts = np.where(n >= k, full, (n > 0).astype(np.int64))
    out = np.zeros(int(counts.sum()), np.uint64)
    to = np.cumsum(counts) - counts
    out[A.ranges(to, full)] = h[own]
    for i in short.tolist():                      # a text of fewer than k words is one k-mer
        x = word[at[i]:at[i] + n[i]]
        out[to[i]] = A.gram_hashes(x, len(x))[0] ^ A.U64(len(x))
    # label: the number of earlier occurrences in the same text
    doc = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
    key = A.mix(out ^ (doc * A.MULT))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    if again.any():
        pos = np.arange(len(key))
        nth = pos - np.maximum.accumulate(np.where(again, 0, pos))
        rep = order[again]
        out[rep] = A.mix(out[rep] + nth[again].astype(np.uint64) * A.FAR_BASE)
    return out, counts, word, n


def sketches(kmers: np.ndarray, counts: np.ndarray, tables: int = TABLES, sample: int = SAMPLE) -> np.ndarray:
    """(texts, tables) entries; rows of texts without k-mers are zero."""
    out = np.zeros((len(counts), tables), np.uint64)
    some = np.flatnonzero(counts > 0)
    if not len(some):
        return out
    n = counts[some]
    at = np.cumsum(n) - n
    top = A.U64(np.iinfo(np.uint64).max)
    for t in range(tables):
        v = A.mix(kmers ^ SEEDS[t])
        places = np.empty((len(some), sample), np.int64)
        for j in range(sample):
            least = np.minimum.reduceat(v, at)
            hit = np.flatnonzero(v == np.repeat(least, n))
            first = hit[np.searchsorted(hit, at)]     # every text has a place of its minimum
            used_up = least == top
            places[:, j] = np.where(used_up, -1, first)
            v[first] = top
        places.sort(axis=1)                            # text order
        entry = np.full(len(some), t + 1, np.uint64)
        for j in range(sample):
            p = places[:, j]
            entry = A.mix(entry * A.BASE + np.where(p < 0, A.U64(7), kmers[p]))
        out[some, t] = entry
    return out


SKETCH_SCHEMA = "doc_id long, row long, th long, w1 long, w2 long, n_words long, entries array<long>"


def _sketch(k: int, tables: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = A.arrow_bytes(b.column("text"))
            kmers, counts, word, n = labelled_kmers(data, offs, k)
            entries = sketches(kmers, counts, tables, sample)
            ends = np.concatenate([[0], np.cumsum(n)])
            place = np.arange(len(word)) - np.repeat(ends[:-1], n)
            p, _ = A.powers(1 << 16)
            sums = []
            for seed in (A.U64(3), A.U64(5)):          # 128 bits of the word sequence
                term = A.mix(word * seed) * p[place & 0xFFFF] + (place >> 16).astype(np.uint64) * A.mix(word + seed)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
                sums.append(pa.array(A.mix(total[ends[1:]] - total[ends[:-1]]).view(np.int64)))
            flat = pa.array(entries.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * tables + 1, tables), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "row", "th")], *sums, pa.array(n), lists],
                                             names=["doc_id", "row", "th", "w1", "w2", "n_words", "entries"])
    return run


def _labels(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = A.arrow_bytes(b.column("text"))
            kmers, counts, _, _ = labelled_kmers(data, offs, k)
            raw = (kmers >> A.U64(32)).astype(np.uint32).tobytes()
            at = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                                             names=["node", "kmers"])
    return run


def rising(seq: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    tails: list[int] = []
    for x in seq:
        i = bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
        else:
            tails[i] = x
    return len(tails)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-aware Jaccard of two labelled k-mer sequences, exact from ``least`` up."""
    total = len(a) + len(b)
    need = least / (1 + least) * total               # matches of a pair that is similar enough
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    band = total - 2 * need + 1                       # its unmatched k-mers bound the shift
    keep = np.abs(i - j) <= band
    i, j = i[keep], j[keep]
    j = j[np.argsort(i)]
    n = len(j) if len(j) < 2 or (np.diff(j) > 0).all() else rising(j.tolist())
    return n / (total - n) if total else 0.0


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [aligned_similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) >= least
                    for x, y in zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _agreement(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def _compare(nodes: np.ndarray, label: np.ndarray, grams: np.ndarray, entries: np.ndarray, left: np.ndarray, right: np.ndarray,
             major: np.ndarray, table: int, min_agree: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (x, y) of the pairs of a tile that may be similar, those that agree most first:
    x of ``left`` and y of ``right``, of different classes, in their first common bucket, with
    lengths that allow the similarity; of two that are both on the left, once."""
    e, f = entries[left], entries[right]
    ok = label[left][:, None] != label[right][None]
    ok &= ~(~major[right][None] & (nodes[left][:, None] >= nodes[right][None]))
    short = np.minimum(grams[left][:, None], grams[right][None])
    ok &= short >= similarity * np.maximum(grams[left][:, None], grams[right][None]) - 1e-6
    agree = np.zeros(ok.shape, np.int16)
    for t in range(entries.shape[1]):
        same = e[:, t][:, None] == f[:, t][None]
        if t < table:
            ok &= ~same
        agree += same
    x, y = np.nonzero(ok & (agree >= min_agree))
    order = np.argsort(-agree[x, y], kind="stable")
    return left[x[order]], right[y[order]]


def _spanning(similarity: float, min_agree: int):
    """Tiles of buckets, all pairs of which are compared here: returns a spanning forest of the
    links found, so at most one row for each text and tile."""
    def run(table: pa.Table) -> pa.Table:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = i = root.get(up, up)
            return i

        table = table.sort_by([(c, "ascending") for c in ("table", "entry", "i", "j", "node")])
        col = lambda c: table.column(c).to_numpy()
        key = np.stack([col(c) for c in ("table", "entry", "i", "j")], axis=1)
        nodes, label, grams, major, side = col("node"), col("label"), col("grams"), col("is_major"), col("side")
        flat = table.column("entries").combine_chunks()
        entries = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy().reshape(len(nodes), -1)
        kmers = [np.frombuffer(x, np.uint32) for x in table.column("kmers").to_pylist()]
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))).tolist() if len(nodes) else []
        a, b = [], []
        for lo, hi in zip(cut, [*cut[1:], len(nodes)], strict=False):
            at = np.arange(lo, hi)
            left, right = at[side[lo:hi] != RIGHT], at[side[lo:hi] != LEFT]
            for x, y in zip(*_compare(nodes, label, grams, entries, left, right, major, int(key[lo, 0]), min_agree, similarity), strict=True):
                p, q = find(int(label[x])), find(int(label[y]))
                if p != q and aligned_similarity(kmers[x], kmers[y], similarity) >= similarity:
                    root[max(p, q)] = min(p, q)
                    a.append(int(nodes[x]))
                    b.append(int(nodes[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _mixed(members: DataFrame) -> DataFrame:
    """The buckets (table, entry) whose members are of several classes, with their size ``n``,
    the commonest class ``major`` and the number of the others, ``minor``."""
    by = ["table", "entry"]
    sizes = members.groupBy(*by, "label").agg(F.count("*").alias("m"))
    most = F.max(F.struct("m", "label")).alias("most")
    return (sizes.groupBy(*by).agg(most, F.sum("m").alias("n"), F.count("*").alias("classes")).filter("classes > 1")
            .select(*by, "n", F.col("most.label").alias("major"), (F.col("n") - F.col("most.m")).alias("minor")))


def _tiles(members: DataFrame, mixed: DataFrame, whole: bool) -> DataFrame:
    """Rows of the tiles: table, entry, i, j, side and the member's columns.  ``whole``: a
    bucket is cut into parts of about ``TILE`` members, each a tile by itself.  Otherwise the
    members outside the commonest class, in parts ``i``, meet all members, in parts ``j``."""
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "table", "node"), F.ceil(F.col(n) / TILE))
    met = members.join(mixed, ["table", "entry"]).withColumn("is_major", F.col("label") == F.col("major"))
    if whole:
        return (met.withColumns({"i": place(3, "n"), "j": F.lit(0).cast("long"), "is_major": F.lit(False), "side": F.lit(BOTH)})
                .drop("n", "major", "minor"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / TILE) - 1))
    left = met.filter(~F.col("is_major")).withColumns({"i": place(1, "minor"), "side": F.lit(LEFT)}).withColumn("j", every("n"))
    right = met.withColumns({"j": place(2, "n"), "side": F.lit(RIGHT)}).withColumn("i", every("minor"))
    return left.unionByName(right).drop("n", "major", "minor")


def _tile_links(tiles: DataFrame, reps: DataFrame, kmers: DataFrame, similarity: float, min_agree: int, k: int) -> DataFrame:
    """Spanning links (a, b) of the tiles.  Small tiles are dealt to groups of ``GROUP`` rows."""
    tiles = saved(tiles, "tiles")
    n = tiles.count()
    grams = F.greatest(F.col("n_words") - (k - 1), F.lit(1)).alias("grams")
    rows = (tiles.join(reps.select("node", "entries", grams), "node").join(kmers, "node")
            .withColumn("deal", F.pmod(F.xxhash64("table", "entry", "i", "j"), F.lit(max(1, -(-n // GROUP))))))
    return rows.groupBy("deal").applyInArrow(_spanning(similarity, min_agree), "a long, b long")


def _links(pairs: DataFrame, kmers: DataFrame, similarity: float) -> DataFrame:
    """The pairs that are similar enough."""
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    few = used.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    own = kmers.join(F.broadcast(used) if few else used, "node", "left_semi")
    cand = (pairs.join(own.select(F.col("node").alias("b"), F.col("kmers").alias("kb")), "b")
            .join(own.select(F.col("node").alias("a"), F.col("kmers").alias("ka")), "a").select("a", "b", "ka", "kb"))
    return cand.mapInArrow(_verify(similarity), "a long, b long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component; edges (a, b)."""
    both = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    cur = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = (both.join(cur.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l")))
        step = (cur.join(near.withColumnRenamed("u", "node"), "node")
                .select("node", F.col("label").alias("old"), F.least("label", "l").alias("label")))
        jump = cur.select(F.col("node").alias("p"), F.col("label").alias("up"))   # to where the new label points already
        step = step.join(jump, F.col("label") == F.col("p"), "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        cur = saved(step, "labels")
        if cur.filter("label < old").isEmpty():
            return nodes.join(cur.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _joined(labels: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes after new links; those so far are stars around their labels, so few
    steps join them."""
    stars = labels.filter("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b"))
    return components(stars.unionByName(found.select("a", "b")), nodes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, tables: int = TABLES,
                    sample: int = SAMPLE, min_agree: int = MIN_AGREE, similarity: float = SIMILARITY, buckets: int = BUCKETS,
                    row_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the id that stays), class_size and
    kept.  ``row_col`` names a column with distinct numbers to use, and return as ``row``,
    instead of new ones."""
    tune(docs.sparkSession)
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text = F.coalesce(q(text_col).cast("string"), F.lit(""))
    row = q(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(q(id_col).cast("long").alias("doc_id"), row.alias("row"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    sketched = saved(base.mapInArrow(_sketch(k, tables, sample), SKETCH_SCHEMA), "sketches")
    words = ["w1", "w2", "n_words"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "th")).alias("first")
    reps = (sketched.filter("n_words > 0").groupBy(*words).agg(first, F.any_value("entries").alias("entries"))
            .select(F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), *words, "entries"))
    reps = saved(reps, "texts")
    cells = reps.select("node", F.posexplode(F.slice("entries", 1, min(buckets, tables))).alias("table", "entry"))
    ends = cells.groupBy("table", "entry").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    shared = saved(cells.join(ends, ["table", "entry"]), "buckets")
    pair = lambda end: (F.when(F.col("node") != F.col(end), F.struct(F.least("node", end).alias("a"), F.greatest("node", end).alias("b"))))
    pairs = shared.select(F.explode(F.array_compact(F.array(pair("lo"), pair("hi")))).alias("p")).select("p.a", "p.b").distinct()
    side = lambda n: reps.select(F.col("node").alias(n), F.col("entries").alias(f"e{n}"))
    pairs = saved(pairs.join(side("a"), "a").join(side("b"), "b").filter(_agreement("ea", "eb") >= min_agree).select("a", "b"), "pairs")
    # the k-mers of the texts that share a bucket, once
    need = (reps.join(shared.select("node").distinct(), "node").select("node", F.col("doc_id").alias("d"), F.col("th").alias("t")))
    source = base.select("doc_id", "th", "text")
    kmers = source.join(need, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("node", "text")
    kmers = saved(kmers.mapInArrow(_labels(k), "node long, kmers binary").dropDuplicates(["node"]), "kmers")
    nodes = reps.select("node", *words)
    links = saved(_links(pairs, kmers, similarity), "links")
    labels = saved(components(links, nodes), "classes")
    # buckets of several classes: parts of them first, then what parts have kept apart
    for whole in (True, False):
        members = shared.select("table", "entry", "node").join(labels.select("node", "label"), "node")
        mixed = saved(_mixed(members).filter(F.lit(True) if whole else F.col("n") > TILE), "mixed")
        if mixed.isEmpty():
            break
        found = saved(_tile_links(_tiles(members, mixed, whole), reps, kmers, similarity, min_agree, k), "links")
        if not found.isEmpty():
            labels = saved(_joined(labels, found, nodes), "classes")
    member = (sketched.select("doc_id", "row", *words).join(labels.select(*words, "label"), words, "left")
              .withColumn("label", F.coalesce("label", "row")))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    member = saved(member.drop(*words), "members")
    # a table of its own, so that the members' side of the join can be split
    classes = saved(member.groupBy("label").agg(best, F.count("*").alias("class_size")), "classes")
    return member.join(classes, "label").select("doc_id", "row", F.col("best.doc_id").alias("class_id"), "class_size",
                                                (F.col("row") == F.col("best.row")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class of near duplicates; all columns stay."""
    (row,) = fresh(docs, "near_row")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(numbered, row_col=row, **options).filter(~F.col("kept")).select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*quoted(docs))
