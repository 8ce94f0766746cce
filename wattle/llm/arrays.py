"""Numpy helpers that work on a batch of texts as one byte array.

A batch is (``data``: uint8, ``offs``: int64 of length n + 1); text ``i`` is
``data[offs[i]:offs[i + 1]]``.  Nothing here knows Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: items handled at once: temporaries of 8 bytes an item stay in a core's cache
BLOCK = 1 << 16
_rng = np.random.Generator(np.random.PCG64(20240607))
#: one random 64-bit value for each byte value, and odd multipliers
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
FAR_BASE = U64(0xC2B2AE3D27D4EB4F)
MULT = U64(0xD6E8FEB86659FD93)

_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64 for i < n (kept between calls)."""
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        inv = U64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("pow", BASE), ("inv", inv)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(32))
    x *= MULT
    x ^= x >> U64(29)
    x *= MULT
    x ^= x >> U64(32)
    return x


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offs) of a binary Arrow array; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=kind)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def byte_set(spec: str) -> np.ndarray:
    """Boolean table of the bytes that the pattern class ``spec`` matches;
    bytes of non-ASCII characters (0x80 and above) never match."""
    import re

    r = re.compile(f"[{spec}]")
    return np.array([i < 128 and bool(r.match(chr(i))) for i in range(256)])


SPACES = byte_set(r"\x20\x09-\x0D")
#: what separates words in the contamination rule, after A-Z is lower-cased
NOT_ALNUM = byte_set(r"\x00-\x2F\x3A-\x60\x7B-\x7F")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data`` and the count of words of each text.
    Words never cross texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    inside = ~separator[data]
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every (non-empty, disjoint, ordered) byte span."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):                      # blocks of spans: bounded temporaries
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        s, e = starts[i:j], ends[i:j]
        lens = e - s
        total = int(lens.sum())
        at = np.cumsum(lens) - lens
        rel = np.arange(total) - np.repeat(at, lens)
        src = np.repeat(s - at, lens) + np.arange(total)
        p, _ = powers(1 << 16)
        term = BYTE_CODE[data[src]] * p[rel & 0xFFFF]
        if lens.max() > 0xFFFF:
            term *= _far(rel >> 16)
        out[i:j] = mix(np.add.reduceat(term, at) + lens.astype(np.uint64) * MULT)
        i = j
    return out


def _far(i: np.ndarray) -> np.ndarray:
    t = np.full(int(i.max()) + 1, FAR_BASE, dtype=np.uint64)
    t[0] = 1
    return np.cumprod(t, dtype=np.uint64)[i]


def gram_hashes(sym: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``sym[i:i + k]`` for every i (len(sym) - k + 1 of them)."""
    n = len(sym)
    if n < k:
        return np.zeros(0, np.uint64)
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(sym * p[:n], out=total[1:])
    return mix((total[k:] - total[:n - k + 1]) * inv[:n - k + 1])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``v[i:i + w]`` for every i."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = w - size
    return np.minimum(v[:n], v[rest:rest + n]) if rest else v[:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order: by a sort, many times faster than ``np.unique``, which hashes."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + l)``."""
    total = int(lens.sum())
    at = np.cumsum(lens) - lens
    return np.repeat(starts - at, lens) + np.arange(total)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the positions that lie in some ``[s, s + width)``."""
    diff = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(diff[:-1]) > 0
