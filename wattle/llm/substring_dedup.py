"""Substring dedup by seed and extend: remove every word that lies in a run of 20 words
which also starts earlier (in a document with a smaller id, or earlier in the same one).

Documents are joined on winnowed anchors of ten words (``repeats``).  In a bucket all
occurrences of an anchor are extended to the right and to the left one word at a time:
occurrences that agree on the next word stay in one group, so after ``r`` steps a group
holds exactly the occurrences with equal right stretches of ``r`` words, and likewise to
the left.  An anchor with equal left and right stretches of together ten more words is a
repeat of 20 words; the union of the repeats of a document is its set of maximal repeats
over the threshold.  Groups are refined, pairs are never listed, so thousands of copies
cost no more than their number.

Defined cases: null, empty and blank texts have no words; a null id sorts after all
others; rows that share a document id count as one document, and equal starts in it are
one occurrence (neither removes the other); other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattle.llm import arrays as A
from wattle.llm import repeats

WIDTH = 20
ANCHOR = 10

SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _refine(group: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
    """Groups of equal (group, next word)."""
    return _dense(group * np.int64(n_words) + word)


def extend_seeds(bucket: repeats.Bucket, width: int = WIDTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the bucket the least (document key, start) among its copies."""
    data = np.frombuffer(b" ".join(bucket.texts) + b" ", np.uint8)
    lens = np.array([len(t) + 1 for t in bucket.texts], np.int64)
    offs = np.concatenate([[0], np.cumsum(lens)])
    s, e, counts = A.word_spans(data, offs, A.SPACES)
    word = _dense(A.span_hashes(data, s, e))
    n_words = int(word.max()) + 1 if len(word) else 1
    at = np.cumsum(counts) - counts
    # the seeds of a context: each window's own minimum gram, found again from the words
    h = A.gram_hashes(A.span_hashes(data, s, e), k)
    start = A.ranges(at, bucket.windows)                     # first word of every window
    grams = width - k + 1
    bits = A.U64((1 << max(24, len(h).bit_length())) - 1)    # as wide as the bucket needs
    v = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    anchor = (A.sliding_min(v, grams)[start] & bits).astype(np.int64)
    seed_at, seed_of = np.unique(anchor, return_inverse=True)
    seed = _dense(h[seed_at])
    last = len(word) - 1
    right, left = [seed], [seed]
    for step in range(1, grams):
        right.append(_refine(right[-1], word[np.minimum(seed_at + k - 1 + step, last)], n_words))
        left.append(_refine(left[-1], word[np.maximum(seed_at - step, 0)], n_words))
    before = anchor - start                                  # words of the window left of its seed
    lefts, rights = np.stack(left), np.stack(right)
    pair = lefts[before, seed_of] * np.int64(len(seed) + 1) + rights[grams - 1 - before, seed_of]
    copy = _refine(_dense(pair), before, grams)              # windows with equal seed, side and stretches
    key = np.repeat(bucket.doc_key, bucket.windows)
    pos = np.repeat(bucket.start, bucket.windows) + A.ranges(np.zeros(len(at), np.int64), bucket.windows)
    order = np.lexsort([pos, key, copy])
    first = order[np.unique(copy[order], return_index=True)[1]]
    return key[first][copy], pos[first][copy]


def _emit(c: repeats.Chunk, gone: np.ndarray) -> pa.Table:
    total = np.concatenate([[0], np.cumsum(gone)])
    keep = ~gone
    lens = (c.norm_end - c.norm_at + 1)[keep]
    norm = np.frombuffer(c.norm, np.uint8)
    text = norm[A.ranges(c.norm_at[keep], lens)].tobytes() if len(lens) else b""
    size = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(keep)])[c.sym_offs]]
    kept = [text[i:j - 1] if j > i else b"" for i, j in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(c.ids, pa.int64(), mask=c.ids == repeats.NO_ID),
                     "n_words": pa.array(np.diff(c.sym_offs)), "n_removed": pa.array(np.diff(total[c.sym_offs]), pa.int64()),
                     "kept": pa.array(kept, pa.binary()).cast(pa.string())}, schema=ARROW)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    anchor: int = ANCHOR, **sizes: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and the kept words joined by one
    space (``kept``).  See the module text for the rule and the defined cases."""
    spec = repeats.Spec(by_words=True, width=width, k=min(anchor, width), same_text=True)
    return repeats.run(spec, docs, lambda b: extend_seeds(b, width, spec.k), _emit, SCHEMA, ARROW,
                       id_col, text_col, **sizes)
