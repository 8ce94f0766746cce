"""Candidate exchange for exact repeats: which windows of a text also occur elsewhere.

Used by the two substring operators (bytes with suffix arrays, words with seed
and extend).  A *window* is ``width`` consecutive symbols of one text.  The
minimum-hash ``k``-gram of a window (its *anchor*, winnowing with
``width - k + 1`` grams) depends on the window alone, so equal windows have
equal anchors, and a window can repeat only if its anchor does.

1. ``chunk_table``: texts are packed into chunk rows of about 4 MB (compressed
   blobs) and written to the shared folder.  A chunk is the unit of work.
2. ``repeated_anchors``: every chunk sends its distinct anchor hashes, one blob
   per group of buckets, and gets back one bit per hash: occurs elsewhere or not.
3. ``contexts``: the stretch of text around each repeated anchor that covers the
   windows it stands for goes to the anchor's bucket, once per chunk however
   often the chunk repeats it.  Anchors with very many contexts (counted per chunk
   and summed) or in very many chunks are *hot*: their windows are sent one by one,
   routed by their own content, so no bucket gathers all surroundings of a common
   passage.
4. The bucket function of the operator finds equal windows and answers one bit
   per window: occurs earlier in another chunk's or context's copy.
5. ``resolve``: every chunk combines the answers with what it knows locally
   into the set of its repeated windows and emits per-document results.

Buckets are sent in groups of neighbours, one blob for each chunk and group.  Blobs grow with
the text while there are ``GROUPS`` groups (4 GB of text), beyond with its square, but are a
sixteenth of what one for each chunk and bucket would be.

Every step is a shuffle of bounded blobs; nothing reaches the driver but the
sum of the text sizes.  All steps are deterministic functions of the chunk
rows, so tasks that rerun after an executor is lost give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.llm import arrays as A
from wattle.llm.common import id_and_text, saved, tune

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20          # text bytes for which one bucket is made
GROUP_BYTES = 32 << 20          # text bytes for which one group of buckets is made,
GROUPS = 128                    # but so many at least, if there are as many buckets
HOT_CHUNKS = 4096               # an anchor in more chunks than this is routed by window
HOT_CONTEXTS = 16384            # and so is one with more contexts than this, summed over the chunks
NO_ID = np.iinfo(np.int64).max  # stands for a null id: sorts after every id

CHUNK_SCHEMA = "chunk long, n_bytes long, ids binary, lens binary, text binary"
BLOB_SCHEMA = "part int, chunk long, blob binary"


@dataclass(frozen=True)
class Spec:
    """``by_words``: symbols are whitespace-separated words, else bytes.
    ``same_text``: an earlier start in the same document counts as earlier."""
    by_words: bool
    width: int
    k: int
    same_text: bool

    @property
    def grams(self) -> int:
        return self.width - self.k + 1


def _pack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b)


def _unpack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


# --- chunks -----------------------------------------------------------------

def chunk_table(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per about ``chunk_bytes`` of text (a longer text is alone in its row)."""
    tune(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal seq, size
            out = pa.RecordBatch.from_pydict({
                "chunk": pa.array([(part << 32) | seq], pa.int64()), "n_bytes": pa.array([size], pa.int64()),
                "ids": [np.array(ids, np.int64).tobytes()],
                "lens": [np.array([len(t) for t in texts], np.int64).tobytes()],
                "text": [_pack(b"".join(texts))]})
            seq, size = seq + 1, 0
            ids.clear()
            texts.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                size += len(t)
                if size >= chunk_bytes:
                    yield row()
        if ids:
            yield row()

    return saved(id_and_text(docs, id_col, text_col).mapInArrow(pack, CHUNK_SCHEMA), "chunks")


class Chunk:
    """A decoded chunk: symbols, documents and the runs of windows with one anchor."""

    def __init__(self, spec: Spec, ids: bytes, lens: bytes, text: bytes):
        self.spec = spec
        self.ids = np.frombuffer(ids, np.int64)
        byte_lens = np.frombuffer(lens, np.int64)
        self.text = _unpack(text)
        self.data = np.frombuffer(self.text, np.uint8)
        self.offs = np.concatenate([[0], np.cumsum(byte_lens)])
        if spec.by_words:
            self.starts, self.ends, counts = A.word_spans(self.data, self.offs, A.SPACES)
            self.words = A.span_hashes(self.data, self.starts, self.ends)
            self.sizes = counts
            # words joined by one space each, so that a context is a plain slice
            lens1 = self.ends - self.starts + 1
            self.norm_at = np.cumsum(lens1) - lens1
            src = A.ranges(self.starts, lens1)
            norm = self.data[np.minimum(src, max(len(self.data) - 1, 0))].copy() if len(src) else self.data[:0]
            if len(src):
                norm[self.norm_at + lens1 - 1] = 32
            self.norm = norm.tobytes()
            self.norm_end = self.norm_at + lens1 - 1
        else:
            self.sizes = byte_lens
        self.sym_offs = np.concatenate([[0], np.cumsum(self.sizes)])
        self.n = int(self.sym_offs[-1])
        self._runs()

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        return self.words[lo:hi] if self.spec.by_words else A.BYTE_CODE[self.data[lo:hi]]

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sym_offs, pos, "right") - 1

    def _runs(self) -> None:
        s = self.spec
        los, his, hashes = [], [], []
        for lo in range(0, max(self.n - s.width + 1, 0), A.BLOCK):
            hi = min(lo + A.BLOCK, self.n - s.width + 1)          # window starts [lo, hi)
            h = A.gram_hashes(self.symbols(lo, hi + s.width - 1), s.k)
            bits = A.U64((1 << 21) - 1)
            v = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
            best = A.sliding_min(v, s.grams) & bits               # anchor of each window
            ok = np.ones(hi - lo, bool)                           # windows that stay in one text
            d0, d1 = np.searchsorted(self.sym_offs, [lo, hi + s.width])
            for end in self.sym_offs[d0:d1]:
                ok[max(end - s.width + 1 - lo, 0):max(min(end - lo, hi - lo), 0)] = False
            step = np.empty(hi - lo, bool)
            step[0] = ok[0]
            step[1:] = ok[1:] & ((best[1:] != best[:-1]) | ~ok[:-1])
            first = np.flatnonzero(step)
            stop = np.empty(hi - lo, bool)
            stop[-1] = ok[-1]
            stop[:-1] = ok[:-1] & ((best[1:] != best[:-1]) | ~ok[1:])
            los.append(first + lo)
            his.append(np.flatnonzero(stop) + 1 + lo)
            # anchors are minima: mixed again, their values spread evenly over the buckets
            hashes.append(A.mix(h[best[first].astype(np.int64)] + A.FAR_BASE))
        z = np.zeros(0, np.int64)
        self.lo = np.concatenate(los) if los else z               # window starts [lo, hi) of each run
        self.hi = np.concatenate(his) if his else z
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range (of the text, or of the normalised text) that the windows [lo, hi) cover."""
        if len(lo) and self.spec.by_words:
            return self.norm_at[lo], self.norm_end[hi + self.spec.width - 2]
        return lo, hi + self.spec.width - 1


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> A.U64(32)) * A.U64(n) >> A.U64(32)).astype(np.int64)


@dataclass(frozen=True)
class Deal:
    """``groups`` of ``per`` buckets each; a group is what is shuffled."""
    groups: int
    per: int

    def group(self, h: np.ndarray) -> np.ndarray:
        return _bucket(h, self.groups)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        """Buckets ``g * per``, .. ``g * per + per - 1`` are those of group g."""
        return _bucket(h, self.groups * self.per)

    def cut(self, group: np.ndarray) -> np.ndarray:
        """Where each group begins in the sorted ``group``, and the end."""
        return np.searchsorted(group, np.arange(self.groups + 1))


def deal(n_bytes: int, bucket_bytes: int) -> Deal:
    buckets = max(1, -(-n_bytes // bucket_bytes))
    groups = min(buckets, max(GROUPS, -(-n_bytes // GROUP_BYTES)))
    return Deal(groups, -(-buckets // groups))


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of each hash; the group's number adds others."""
    return h & A.U64((1 << 48) - 1)


def _blob_batches(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        b, c, x = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(x, pa.binary())],
                                         names=["part", "chunk", "blob"])


def _blob_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
    return pa.Table.from_batches(list(_blob_batches(rows)), schema)


def _chunks(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("chunk")[i].as_py(), Chunk(spec, *(b.column(c)[i].as_py() for c in ("ids", "lens", "text")))


def _bits(cells: pa.Table, column: str = "blob") -> dict[int, bytes]:
    return dict(zip(cells.column("part").to_pylist(), cells.column(column).to_pylist(), strict=True))


def _more_contexts(c: Chunk, u: np.ndarray) -> np.ndarray:
    """For each distinct anchor of the chunk the number of its distinct contexts less one."""
    at = np.searchsorted(u, c.hash)
    count = np.bincount(at, minlength=len(u))
    more = np.zeros(len(u), np.uint32)
    runs = np.flatnonzero(count[at] > 1)
    if len(runs):
        begin, end = c.bounds(c.lo[runs], c.hi[runs])
        body = c.norm if c.spec.by_words else c.text
        own = {(a, body[i:j]) for a, i, j in zip(at[runs].tolist(), begin.tolist(), end.tolist(), strict=True)}
        which, n = np.unique(np.array([a for a, _ in own], np.int64), return_counts=True)
        more[which] = n - 1
    return more


def repeated_anchors(spec: Spec, chunks: DataFrame, dealt: Deal, hot_chunks: int, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(part, chunk, blob): two bit sets over the chunk's sorted distinct anchors of
    that group: occurs in another chunk; is hot, that is, occurs in more than
    ``hot_chunks`` chunks or has more than ``hot_contexts`` contexts in all chunks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c in _chunks(spec, batches):
            u = A.distinct(c.hash)
            cut = dealt.cut(dealt.group(u))
            raw = _short(u).view(np.uint8).reshape(-1, 8)[:, :6]
            more = _more_contexts(c, u)
            some = np.flatnonzero(more)
            part = np.searchsorted(some, cut)
            rows = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = some[part[b]:part[b + 1]]                    # few anchors have several contexts in a chunk
                rows.append((b, chunk, np.array([cut[b + 1] - cut[b]], np.int64).tobytes() + raw[cut[b]:cut[b + 1]].tobytes()
                             + (own - cut[b]).astype(np.uint32).tobytes() + more[own].tobytes()))
            yield from _blob_batches(rows)

    def meet(cells: pa.Table) -> pa.Table:
        names = cells.column("chunk").to_pylist()
        sets, extra = [], []
        for x in cells.column("blob").to_pylist():
            size = int(np.frombuffer(x, np.int64, 1)[0])
            wide = np.zeros((size, 8), np.uint8)
            wide[:, :6] = np.frombuffer(x, np.uint8, 6 * size, 8).reshape(-1, 6)
            sets.append(wide.view(np.uint64).ravel())
            extra.append(np.frombuffer(x[8 + 6 * size:], np.uint32).reshape(2, -1))
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        surroundings = counts.astype(np.int64)
        for s, (which, more) in zip(sets, extra, strict=True):
            np.add.at(surroundings, np.searchsorted(values, s[which]), more.astype(np.int64))
        is_hot = (counts > hot_chunks) | (surroundings > hot_contexts)
        part = cells.column("part")[0].as_py()
        rows = []
        for name, s in zip(names, sets, strict=True):
            at = np.searchsorted(values, s)
            rows.append((part, name, np.packbits(counts[at] > 1).tobytes() + np.packbits(is_hot[at]).tobytes()))
        return _blob_table(rows)

    return chunks.mapInArrow(send, BLOB_SCHEMA).groupBy("part").applyInArrow(meet, BLOB_SCHEMA)


# --- contexts ---------------------------------------------------------------

class Contexts:
    """The distinct contexts of a chunk, by bucket and so by group, in an order that both passes share.

    ``ref``: for each (run or, if hot, window) the number of its context;
    ``key``: for each context the least (document key, start) where the chunk has it.
    """

    def __init__(self, c: Chunk, marks: dict[int, bytes], dealt: Deal):
        u = A.distinct(c.hash)
        at = np.searchsorted(u, c.hash)
        cut = dealt.cut(dealt.group(u))
        often, hot = np.bincount(at, minlength=len(u)) > 1, np.zeros(len(u), bool)
        for b, x in marks.items():
            lo, hi = int(cut[b]), int(cut[b + 1])
            bits = np.frombuffer(x, np.uint8).reshape(2, -1)
            often[lo:hi] |= np.unpackbits(bits[0], count=hi - lo).astype(bool)
            hot[lo:hi] = np.unpackbits(bits[1], count=hi - lo).astype(bool)
        runs = np.flatnonzero(often[at])
        is_hot = hot[at[runs]]
        single = runs[is_hot]
        n_hot = c.hi[single] - c.lo[single]
        hot_starts = A.ranges(c.lo[single], n_hot)
        self.lo = np.concatenate([c.lo[runs[~is_hot]], hot_starts])
        self.hi = np.concatenate([c.hi[runs[~is_hot]], hot_starts + 1])
        doc = c.doc_of(self.lo)
        order = np.lexsort([self.lo - c.sym_offs[doc], c.ids[doc]]) if len(doc) else np.zeros(0, np.int64)
        self.lo, self.hi, is_hot_row = self.lo[order], self.hi[order], (order >= (~is_hot).sum())
        hashes = np.concatenate([c.hash[runs[~is_hot]], np.repeat(c.hash[single], n_hot)])[order]
        self.doc = c.doc_of(self.lo)
        self.doc_key = c.ids[self.doc]
        self.start = self.lo - c.sym_offs[self.doc]
        begin, end = c.bounds(self.lo, self.hi)
        body = c.norm if c.spec.by_words else c.text
        known: dict[bytes, int] = {}
        self.ref = np.array([known.setdefault(body[i:j], len(known)) for i, j in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
        self.texts = list(known)
        f = np.unique(self.ref, return_index=True)[1]
        self.first = f
        self.windows = (self.hi - self.lo)[f] if len(f) else f
        route = hashes[f].copy() if len(f) else np.zeros(0, np.uint64)
        if len(f):
            for i in np.flatnonzero(is_hot_row[f]).tolist():   # a single hot window: by its content
                route[i] = _text_hash(self.texts[i])
        bucket = dealt.bucket(route)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.cut = dealt.cut(bucket[self.by_bucket] // dealt.per)          # where the groups begin in that order
        self.within = (bucket % dealt.per).astype(np.int32)                # the bucket in its group


def _text_hash(t: bytes) -> np.uint64:
    a = np.frombuffer(t, np.uint8)
    return A.span_hashes(a, np.array([0]), np.array([len(a)]))[0]


def _marks(spec: Spec, dealt: Deal, left: pa.Table, right: pa.Table) -> tuple[int, Chunk, Contexts] | None:
    if left.num_rows == 0:
        return None
    c = Chunk(spec, *(left.column(x)[0].as_py() for x in ("ids", "lens", "text")))
    return left.column("chunk")[0].as_py(), c, Contexts(c, _bits(right), dealt)


def contexts(spec: Spec, chunks: DataFrame, marks: DataFrame, dealt: Deal) -> DataFrame:
    """(part, chunk, blob): the chunk's distinct contexts for that group and their keys."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        got = _marks(spec, dealt, left, right)
        if got is None:
            return _blob_table([])
        name, _, x = got
        rows = []
        for g in np.flatnonzero(np.diff(x.cut)).tolist():
            own = x.by_bucket[x.cut[g]:x.cut[g + 1]]
            texts = [x.texts[i] for i in own.tolist()]
            f = x.first[own]
            head = np.array([len(own)], np.int64).tobytes()
            body = [np.array([len(t) for t in texts], np.int32).tobytes(), x.windows[own].astype(np.int32).tobytes(),
                    x.within[own].tobytes(), x.doc_key[f].tobytes(), x.start[f].tobytes(), *texts]
            rows.append((g, name, _pack(head + b"".join(body))))
        return _blob_table(rows)

    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(send, BLOB_SCHEMA)


@dataclass
class Bucket:
    """The distinct contexts of a bucket: text, number of windows, least key."""
    texts: list[bytes]
    windows: np.ndarray
    doc_key: np.ndarray
    start: np.ndarray


#: (bucket) -> least (document key, start) of every window, contexts one after another
Finder = Callable[[Bucket], tuple[np.ndarray, np.ndarray]]


def answer(spec: Spec, sent: DataFrame, find: Finder) -> DataFrame:
    """(part, chunk, blob): one bit per window sent: it occurs earlier than where
    the chunk first has its context."""

    def meet(cells: pa.Table) -> pa.Table:
        raws, parts = [], []
        for blob in cells.column("blob").to_pylist():
            raw = _unpack(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            lens, wins, within = np.frombuffer(raw, np.int32, 3 * n, 8).reshape(3, n).astype(np.int64)
            key, start = np.frombuffer(raw, np.int64, 2 * n, 8 + 12 * n).reshape(2, n)
            end = 8 + 28 * n + np.cumsum(lens)
            parts.append((np.full(n, len(raws)), end - lens, end, wins, within, key, start))
            raws.append(raw)
        source, begin, end, wins, within, key, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.cumsum(wins) - wins                                     # windows of each context
        earlier = np.zeros(int(wins.sum()), bool)
        order = np.argsort(within, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(within[order])) + 1):        # a bucket
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(raws[r][i:j], len(known))
                            for r, i, j in zip(source[own].tolist(), begin[own].tolist(), end[own].tolist(), strict=True)], np.int64)
            by = np.lexsort([start[own], key[own], ids])
            first = own[by[np.flatnonzero(np.diff(ids[by], prepend=-1))]]  # least key of each distinct context
            g_key, g_start = find(Bucket(list(known), wins[first], key[first], start[first]))
            at = np.cumsum(wins[first]) - wins[first]                      # windows of each distinct context
            n = wins[own]
            found, off = A.ranges(at[ids], n), A.ranges(np.zeros(len(n), np.int64), n)
            here_k = np.repeat(key[own], n)
            bit = g_key[found] < here_k
            if spec.same_text:
                bit |= (g_key[found] == here_k) & (g_start[found] < np.repeat(start[own], n) + off)
            earlier[A.ranges(place[own], n)] = bit
        stop = np.cumsum([int(p[3].sum()) for p in parts])
        part = cells.column("part")[0].as_py()
        return _blob_table([(part, name, np.packbits(x).tobytes()) for name, x in
                            zip(cells.column("chunk").to_pylist(), np.split(earlier, stop[:-1]), strict=True)])

    return sent.groupBy("part").applyInArrow(meet, BLOB_SCHEMA)


#: (chunk, mask of repeated symbols) -> one record batch of per-document results
Emit = Callable[[Chunk, np.ndarray], pa.Table]


def resolve(spec: Spec, chunks: DataFrame, marks: DataFrame, answers: DataFrame, dealt: Deal,
            emit: Emit, schema: str, empty: pa.Schema) -> DataFrame:
    """Per-document rows from the symbols that lie in a repeated window."""
    both = marks.select("part", "chunk", "blob", F.lit(True).alias("mark")).unionByName(
        answers.select("part", "chunk", "blob", F.lit(False).alias("mark")))

    def combine(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("mark")
        got = _marks(spec, dealt, left, right.filter(kind))
        if got is None:
            return empty.empty_table()
        _, c, x = got
        bits = _bits(right.filter(pc.invert(kind)))
        at = np.cumsum(x.windows) - x.windows
        earlier = np.zeros(int(x.windows.sum()) if len(x.windows) else 0, bool)
        for g, blob in bits.items():
            own = x.by_bucket[x.cut[g]:x.cut[g + 1]]
            pos = A.ranges(at[own], x.windows[own])
            earlier[pos] = np.unpackbits(np.frombuffer(blob, np.uint8), count=len(pos)).astype(bool)
        f = x.first[x.ref] if len(x.ref) else x.ref
        later = x.doc_key > x.doc_key[f]                                  # the chunk itself has it earlier
        if spec.same_text:
            later |= (x.doc_key == x.doc_key[f]) & (x.start > x.start[f])
        n = x.hi - x.lo
        off = A.ranges(np.zeros(len(n), np.int64), n)
        hit = np.repeat(later, n)
        if len(n):
            hit |= earlier[np.repeat(at[x.ref], n) + off]
        return emit(c, A.covered(c.n, (np.repeat(x.lo, n) + off)[hit], spec.width))

    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(combine, schema)


def run(spec: Spec, docs: DataFrame, find: Finder, emit: Emit, schema: str, empty: pa.Schema,
        id_col: str = "doc_id", text_col: str = "text", hot_chunks: int = HOT_CHUNKS,
        chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    chunks = chunk_table(docs, id_col, text_col, chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    dealt = deal(total, bucket_bytes)
    marks = saved(repeated_anchors(spec, chunks, dealt, hot_chunks, hot_contexts), "anchors")
    answers = answer(spec, contexts(spec, chunks, marks, dealt), find)
    return resolve(spec, chunks, marks, answers, dealt, emit, schema, empty)
