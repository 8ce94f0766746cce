r"""URL filter: all wildcard rules simulated at once by a bit-parallel Shift-And automaton.

A canonical URL is ``"." + host + path``, the host with A-Z lower-cased and the path without
query and fragment; where both are empty, as for null and without ``://``, it is empty.  A glob
matches a whole canonical URL: ``?`` is one character but ``/``, ``*`` any run without
``/``, ``**`` any run, ``\`` makes the next character plain.  The rule (host, path) is the
glob ``*.host`` + path + ``**``: its host and all subdomains, paths that start with its own.

Automaton: the UTF-8 bytes of all globs lie end to end in words of 64 bits, one bit for
each place in a glob.  ``D`` holds the places that the bytes read so far can reach; a byte
``c`` makes it ``((D << 1) & take[c]) | (D & stay[c])``, where the shift carries from word to
word, ``take`` are the places entered on ``c`` and ``stay`` those with a wildcard that may
eat ``c``.  The urls of an Arrow batch step together, the longest first, so that those still
running are a prefix of the rows.  Rules are tried before globs, the longest first (for globs
the most plain characters), then in the order given.

Bounds: a batch needs 8 bytes per (url, word of the automaton), the tables 4 KB per word, and
a url one step per byte: time is linear in its length, however long it is.  The rules are a
parameter that the driver holds anyway; they go to the tasks inside the function.  Nothing is
shuffled.

Defined cases: null and unparsable urls have an empty host and path and reach only globs that
match the empty text; a url without a path fits no rule, as no rule's path is empty; rows
with the same id stay separate rows; an empty table gives an empty result; other columns of
the input are ignored, whatever their names; no rules and no globs give ``default``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm.arrays import arrow_bytes
from wattle.llm.common import tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return "*." + escape(self.host) + escape(self.path) + "**"


@dataclass(frozen=True)
class Glob:
    verdict: str
    glob: str


#: fixed values: the rules of the result's contract
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: what decides where no rule fits: words of unwanted hosts, paths that hold no prose, no host at all
SPAM = ("casino", "-pills", "ads-", "spam", "adult", "bets")
GLOBS = (Glob("block", ""),
         *(Glob("block", f"*{w}*{rest}") for w in SPAM for rest in ("", "/**")),
         *(Glob("block", f"**/{p}**") for p in ("login", "cart/", "search", "cgi-bin/")),
         *(Glob("block", f"**.{e}") for e in ("zip", "exe", "jpg", "png", "mp?")))


def escape(text: str) -> str:
    return "".join("\\" + c if c in "\\*?" else c for c in text)


def parse(glob: str) -> list[str]:
    """The glob as a list of ``*``, ``**``, ``?`` and plain characters (``=`` + character)."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            i += 1
            out.append("=" + (glob[i] if i < len(glob) else c))
        elif c == "*":
            n = i
            while n < len(glob) and glob[n] == "*":
                n += 1
            out.append("*" if n - i == 1 else "**")
            i = n - 1
        else:
            out.append("?" if c == "?" else "=" + c)
        i += 1
    return out


def plain_length(glob: str) -> int:
    return sum(s[0] == "=" for s in parse(glob))


class Automaton:
    """Shift-And masks of several globs over bytes."""

    def __init__(self, globs: Sequence[str]):
        places = [[s for part in parse(g) for s in _places(part)] for g in globs]
        size = sum(1 + sum(s[0] == "take" for s in p) for p in places)
        words = max(1, -(-size // 64))
        self.take, self.stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.word, self.bit = np.zeros(len(globs), np.int64), np.zeros(len(globs), np.uint64)
        at = 0
        for k, p in enumerate(places):
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for what, chars in p:
                if what == "take":
                    at += 1
                table = self.take if what == "take" else self.stay
                table[chars, at // 64] |= np.uint64(1 << at % 64)
            self.word[k], self.bit[k] = at // 64, np.uint64(at % 64)
            at += 1

    def first_match(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each text of the batch the first glob that matches it whole, or -1."""
        lens = np.diff(offs)
        order = np.argsort(-lens, kind="stable")
        begin, left = offs[:-1][order], lens[order]
        d = np.repeat(self.start[None, :], len(lens), axis=0)
        longest = int(left[0]) if len(left) else 0
        running = np.searchsorted(-left, -np.arange(longest), "left")       # texts of more than j bytes
        one, top = np.uint64(1), np.uint64(63)
        for j in range(longest):
            n = running[j]
            c = data[begin[:n] + j]
            now = d[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.take[c]
            now &= self.stay[c]
            now |= moved
        out = np.full(len(lens), -1, np.int64)
        if len(self.word) and len(lens):
            hit = (d[:, self.word] >> self.bit) & one
            best = hit.argmax(axis=1)
            out[order] = np.where(hit.any(axis=1), best, -1)
        return out


_ANY = np.arange(256)
_NOT_SLASH = _ANY[_ANY != ord("/")]
_TAIL = np.arange(0x80, 0xC0)                       # bytes of a character after its first


def _places(part: str) -> list[tuple[str, np.ndarray]]:
    if part == "**":
        return [("stay", _ANY)]
    if part == "*":
        return [("stay", _NOT_SLASH)]
    if part == "?":
        return [("take", np.setdiff1d(_NOT_SLASH, _TAIL)), ("stay", _TAIL)]
    return [("take", np.array([b])) for b in part[1:].encode()]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def canonical(host: Column, path: Column) -> Column:
    return F.when((host == "") & (path == ""), F.lit("")).otherwise(F.concat(F.lit("."), host, path))


def precedence(rules: Sequence[Rule], globs: Sequence[Glob]) -> list[Rule | Glob]:
    return [*sorted(rules, key=lambda r: -len(r.name)), *sorted(globs, key=lambda g: -plain_length(g.glob))]


def matcher(globs: Sequence[str]):
    """Column function: position (from 0) of the first of ``globs`` that matches, or -1."""
    globs = list(globs)
    kept: list[Automaton] = []

    @F.arrow_udf("int")
    def first_match(url: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Automaton(globs))
        return pa.array(kept[0].first_match(*arrow_bytes(url)).astype(np.int32))

    return first_match


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[Glob] = GLOBS, default: str = "allow",
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (name of the rule that decided, or
    null), glob (the glob that decided where no rule fits, or null), verdict."""
    tune(pages.sparkSession)
    tried = precedence(rules, globs)
    host, path = host_and_path(F.col(url_col).cast("string"))
    out = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not tried:
        none = F.lit(None).cast("string")
        return out.select("page_id", "host", "path", none.alias("rule"), none.alias("glob"), F.lit(default).alias("verdict"))
    out = out.withColumn("k", matcher([t.glob for t in tried])(canonical(F.col("host"), F.col("path")).cast("binary")) + 1)
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("k"))
    return out.select("page_id", "host", "path",
                      pick([None, *(t.name if isinstance(t, Rule) else None for t in tried)]).alias("rule"),
                      pick([None, *(t.glob if isinstance(t, Glob) else None for t in tried)]).alias("glob"),
                      pick([default, *(t.verdict for t in tried)]).alias("verdict"))


def keep_allowed(pages: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """``pages`` without the rows whose url is blocked; all columns are kept."""
    tried = precedence(options.get("rules", RULES), options.get("globs", GLOBS))
    blocked = [i for i, t in enumerate(tried) if t.verdict == "block"]
    tune(pages.sparkSession)
    host, path = host_and_path(F.col("`" + url_col.replace("`", "``") + "`").cast("string"))
    k = matcher([t.glob for t in tried])(canonical(host, path).cast("binary"))
    if options.get("default", "allow") == "block":
        blocked.append(-1)
    return pages.filter(~k.isin(blocked)) if blocked else pages
