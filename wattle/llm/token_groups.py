"""Two tokenizations of the same bytes, laid over each other (numpy, no Spark).

A text is cut into segments before each space that follows a non-space.  No token of either
vocabulary has a space after a non-space (checked when the vocabularies are loaded), so no
token crosses a cut and both encodings of a text are those of its segments, one after the
other.  Words recur: each distinct segment is encoded and aligned once per task.  Texts with
a segment whose bytes one of the tokenizers does not give back, and all texts where the
vocabularies fail the check, are handled as a single segment.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, islice

import numpy as np

from wattle.llm.arrays import ranges

#: white space, then a run that may hold white space but no space right after a non-space
SEGMENT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
CROSSES = re.compile(r"\S ")
# Fixed value: the pattern by which byte-level tokenizers cut words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: segments and links kept before a task starts anew (memory)
KEEP_SEGMENTS, KEEP_LINKS = 1_000_000, 4_000_000
#: characters of segments that are encoded as one text
CHUNK = 1 << 16


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Tokenizer A (byte-level JSON file) and B (sentence piece model), from their bytes."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"          # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(a_file.decode())
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        char = byte_of_char()
        model = json.loads(a_file)["model"]
        names = {i: t for t, i in model["vocab"].items()}
        self.a_bytes = [bytes(char[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.b_bytes = []
        for i in range(self._b.get_piece_size()):
            p = self._b.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self._ranked = self._by_rank(model)
        self.cuts = not any(CROSSES.search(x.decode("utf-8", "replace")) for x in chain(self.a_bytes, self.b_bytes))
        self.a_text = np.array([[f"{i},", f"{i}|"] for i in range(len(self.a_bytes))], dtype=object)
        self.b_text = np.array([[f"{i},", f"{i};"] for i in range(len(self.b_bytes))], dtype=object)

    def _by_rank(self, model: dict):
        """The same encoding from ranks alone, several times as fast, where the file says that
        ids are ranks: bytes first, then the merges in their order, and the usual words."""
        import tiktoken

        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        split = json.loads(self._a.to_str())["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if (not plain or any(len(x) != 1 for x in self.a_bytes[:256]) or len(set(self.a_bytes[:256])) != 256 or model.get("ignore_merges")
                or any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(merged)) or len(model["vocab"]) != 256 + len(merged)):
            return None
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes)}, special_tokens={})

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their number per segment, ids of B, their number per segment, segments
        whose bytes both give back).  Segments begin with the space that A is given and B adds
        by itself; those that may follow each other are encoded as one text."""
        out, run, size = [], [], 0
        for s in segments:
            if run and (size > CHUNK or not self.cuts or s[0] != " " or run[-1][-1].isspace()):
                out.append(self._encode_run(run))
                run, size = [], 0
            run.append(s)
            size += len(s)
        if run:
            out.append(self._encode_run(run))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _encode_run(self, run: list[str]) -> tuple[np.ndarray, ...]:
        text = "".join(run)
        a = self._ranked.encode_ordinary(text) if self._ranked else self._a.encode(text, add_special_tokens=False).ids
        b = self._b.encode(text[1:], num_threads=1)
        whole = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            ends = np.cumsum([len(s.encode()) for s in run])
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            stop_a, stop_b = (np.searchsorted(np.cumsum(x), ends, "right") for x in (self.a_len[a], self.b_len[b]))
            if (np.add.accumulate(self.a_len[a])[stop_a - 1] == ends).all() and (np.add.accumulate(self.b_len[b])[stop_b - 1] == ends).all():
                return a, np.diff(stop_a, prepend=0), b, np.diff(stop_b, prepend=0), np.ones(len(run), bool)
        if len(run) == 1:
            none = np.zeros(0, np.int64)
            return none, np.zeros(1, np.int64), none, np.zeros(1, np.int64), np.zeros(1, bool)
        return tuple(np.concatenate(x) for x in zip(*(self._encode_run([s]) for s in run), strict=True))


class Aligned:
    """Segments in the order of their numbers: token, group and link counts, link keys
    (A id times the size of B, plus B id) and, if asked for, the groups as text."""

    def __init__(self, voc: Vocabularies, texts: bool):
        self.voc, self.texts = voc, texts
        self.n = np.zeros((0, 3), np.int64)                     # tokens of A, of B, groups
        self.links, self.offs = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.groups: list[str] = []
        self.good = np.zeros(0, bool)

    def add(self, spaced: list[str]) -> None:
        if not spaced:
            return
        voc = self.voc
        a, n_a, b, n_b, good = voc.encode(spaced)
        self.good = np.append(self.good, good)
        # ends of all tokens on one line of bytes; a segment's last end is an end of both
        end_a, end_b = np.cumsum(voc.a_len[a]), np.cumsum(voc.b_len[b])
        some = np.concatenate([end_a, end_b])
        some.sort()
        first = np.append(True, some[1:] != some[:-1]) if len(some) else np.zeros(0, bool)
        ends = some[first]
        # between two ends lies the overlap of exactly one token of A and one of B
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = some[:-1][~first[1:]] if len(some) else some                 # what is an end of A and of B comes twice
        links = a[in_a].astype(np.uint64) * np.uint64(len(voc.b_len)) + b[in_b].astype(np.uint64)
        stop = np.append(0, np.append(0, end_a)[np.cumsum(n_a)])            # last end of each segment
        n_groups = np.diff(np.searchsorted(both, stop, "right"))
        offs = np.searchsorted(ends, stop, "right")
        self.n = np.concatenate([self.n, np.stack([n_a, n_b, n_groups], axis=1)])
        self.links = np.concatenate([self.links, links])
        self.offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
        if self.texts:
            self.groups += self._group_texts(a, b, end_a, end_b, both, n_a + n_b)

    def _group_texts(self, a, b, end_a, end_b, both, n) -> list[str]:
        voc = self.voc
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        # a group's tokens of A come before its tokens of B
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        pieces = np.empty(len(a) + len(b), dtype=object)
        pieces[at_a] = voc.a_text[a, last_a.astype(np.int64)]
        pieces[at_b] = voc.b_text[b, last_b.astype(np.int64)]
        flat, stop = pieces.tolist(), np.cumsum(n).tolist()
        return ["".join(flat[lo:hi])[:-1] for lo, hi in zip([0, *stop], stop, strict=False)]


class Numbers(dict):
    """Numbers texts in the order in which they are asked for first."""

    def __missing__(self, text: str) -> int:
        n = self[text] = len(self)
        return n


class Segments:
    """Numbers the segments of texts and keeps what is known of each."""

    def __init__(self, voc: Vocabularies, texts: bool = False):
        self.voc, self.texts = voc, texts
        self.reset()

    def reset(self) -> None:
        self.number = Numbers()
        self.known = Aligned(self.voc, self.texts)
        self.generation = getattr(self, "generation", -1) + 1

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the segments of all texts in order, offsets of the texts); a text
        that is empty or that a tokenizer changes has none."""
        if len(self.number) > KEEP_SEGMENTS or len(self.known.links) > KEEP_LINKS:
            self.reset()
        split = SEGMENT.findall if self.voc.cuts else (lambda t: [t])
        parts = [split(" " + t) if t else [] for t in texts]
        nums = self._numbers(parts)
        for i, x in enumerate(nums):
            if len(x) and not self.known.good[x].all():
                whole = self._numbers([[" " + texts[i]]])[0]
                nums[i] = whole if self.known.good[whole[0]] else whole[:0]
        offs = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in nums], out=offs[1:])
        return (np.concatenate(nums) if nums else np.zeros(0, np.int64)), offs

    def _numbers(self, parts: list[list[str]]) -> list[np.ndarray]:
        number, before = self.number, len(self.number)
        nums = [np.fromiter(map(number.__getitem__, p), np.int64, len(p)) for p in parts]
        self.known.add(list(islice(number, before, None)))
        return nums

    def links_of(self, nums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(link keys of the numbered segments, their counts per segment)."""
        k = self.known
        n = k.offs[nums + 1] - k.offs[nums]
        return k.links[ranges(k.offs[nums], n)], n


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def text_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per text (0 for a text without any)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
