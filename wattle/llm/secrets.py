"""Secret scan: patterns for known shapes, and two character Markov models for the rest.

Base spans come from three fixed patterns.  The method adds spans of kind ``random``:
runs of token characters that a first-order Markov model of random strings explains
better than one of ordinary tokens, by a log-likelihood ratio of at least ``MIN_RATIO``
in all (which short runs reach only when they are very odd) and ``MIN_MEAN`` for each
step.  Judged are runs of ``LONG`` characters or more, and runs from ``SHORT`` on that are
more than a word: some character after the first is no small letter.  A dot ends a run,
its pieces are judged one by one.  What base spans leave of a run is judged as runs are.

Both models are trained here, on labelled samples: strings that the base patterns caught
are random, each distinct one once; tokens of 6 to 19 characters in documents without a
base span are ordinary, as often as they occur.  The samples are bounded (``SAMPLE_STRINGS`` strings of each kind, the ordinary
ones from ``SAMPLE_DOCS`` documents), so the model is a table of fixed size (pairs of
alphabet characters), which is all that reaches the driver.  Every text is scanned whole.

Everything is DataFrame code: the places of a pattern's matches follow from the lengths
of the matches and of the text between them, summed in blocks.

Defined cases: null counts as empty; a corpus without base spans trains no model and adds
no spans; added spans never overlap base spans; positions are code points, end exclusive;
rows with the same id stay separate rows; other columns are ignored; empty tables work;
the work on a text grows in proportion to its length and to that of its runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm.common import bounded_sample, saved

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind -> (pattern that finds leftmost matches, group that is measured, least characters, cheap necessary test)
KINDS = {
    "assign": (ASSIGN, 1, 6, ASSIGN),
    "access": (ACCESS, 0, 20, r"AKIA[A-Z0-9]{16}"),
    # runs below 24 are dropped anyway and runs never touch, so only the long ones are listed
    "hex": (r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
}
NAMES = [*KINDS, "random"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
TOKEN = "[A-Za-z0-9+/_=-]"
LONG, SHORT = 20, 8
RUN = rf"(?<!{TOKEN})(?:{TOKEN}{{{LONG},}}|(?={TOKEN}[a-z]*[A-Z0-9+/_=-]){TOKEN}{{{SHORT},}})"
WORDLIKE = rf"^{TOKEN}[a-z]*$"
#: shorter than long runs, so that a secret that no pattern catches is no example of the ordinary
ORDINARY = rf"(?<!{TOKEN}){TOKEN}{{6,{LONG - 1}}}(?!{TOKEN})"
SAMPLE_DOCS = 2_000
SAMPLE_STRINGS = 20_000
MIN_RATIO = 12.0
MIN_MEAN = 0.2
#: matches whose lengths are summed in one go
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(sizes: Column) -> Column:
    """array<struct<start, end>> from array<struct<gap, len>>: running sums, in blocks, so
    that no long array is copied for each match."""
    def walk(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
                           lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
                               (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["len"]).alias("end")))).alias("out")))["out"]

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"])

    def begins(blocks: Column) -> Column:
        return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(b))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(begins(bs), 1, F.size(bs)), walk)))


def spans(text: Column, pattern: str, group: int, least: int, test: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches whose group has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(
        F.char_length(gap).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("len")))
    places = _let(sizes, _places)
    # the text after the last match makes one entry too many, which has no value
    found = F.filter(F.zip_with(places, value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value"))),
                     lambda x: F.char_length(x["value"]) >= least)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(test), found).otherwise(none)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, assign, access, hex, runs): base spans by kind, and the runs that the
    models will judge."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    runs = spans(F.col("t"), RUN, 0, SHORT, RUN)
    return d.select("doc_id", "row", *[spans(F.col("t"), *KINDS[k]).alias(k) for k in KINDS], runs.alias("runs"))


def _pairs(value: Column) -> Column:
    """Codes of neighbouring characters: first * base + second, 0 for a foreign one."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.greatest(F.char_length(value) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, steps), F.slice(codes, 2, steps), lambda a, b: a * (len(ALPHABET) + 1) + b)


def _touching(runs: Column, known: Column) -> Column:
    """The members of ``known`` (sorted, apart) that share a character with each run, found
    by sorting: a run that comes as number j and stands at place i has i - j of them before it."""
    def before(end: str) -> Column:
        marks = F.concat(F.transform(known, lambda k: F.struct(k["start"].alias("at"), F.lit(1).alias("run"))),
                         F.transform(runs, lambda r: F.struct((r[end] if end == "start" else r[end] - 1).alias("at"), F.lit(2).alias("run"))))
        places = F.filter(F.transform(F.array_sort(marks), lambda x, i: F.when(x["run"] == 2, i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i, j: i - j)
    spread = F.zip_with(before("start"), before("end"), lambda lo, hi: F.struct(F.greatest(lo, F.lit(1)).alias("lo"), hi.alias("hi")))
    return F.zip_with(runs, spread, lambda r, x: F.filter(F.slice(known, x["lo"], F.greatest(x["hi"] - x["lo"] + 1, F.lit(0))),
                                                          lambda k: k["end"] > r["start"]))


def _rests(runs: Column, kinds: list[Column]) -> Column:
    """What base spans leave of each run, where it is long or odd enough to be judged."""
    def pieces(r: Column, inside: Column) -> Column:
        taken = F.flatten(F.transform(inside, lambda k: F.sequence(k["start"], k["end"] - 1)))
        free = F.array_except(F.sequence(r["start"], r["end"] - 1), taken)
        after = F.transform(free, lambda p: p + 1)
        parts = F.zip_with(F.array_except(free, after), F.array_except(after, free), lambda lo, hi: F.struct(
            lo.alias("start"), hi.alias("end"), F.substr(r["value"], lo - r["start"] + 1, hi - lo).alias("value")))
        return F.filter(parts, lambda p: (F.char_length(p["value"]) >= LONG)
                        | ((F.char_length(p["value"]) >= SHORT) & ~p["value"].rlike(WORDLIKE)))
    touching = F.transform(F.arrays_zip(*[_touching(runs, k).alias(f"k{i}") for i, k in enumerate(kinds)]),
                           lambda z: F.concat(*[z[f"k{i}"] for i in range(len(kinds))]))
    cut = F.flatten(F.zip_with(runs, touching, lambda r, inside: F.when(F.size(inside) == 0, F.array(r)).otherwise(pieces(r, inside))))
    return F.when(F.size(F.concat(*kinds)) == 0, runs).otherwise(cut)


def _pair_counts(strings: DataFrame, limit: int, *place: str) -> dict[int, int]:
    """Counts of character pairs in ``limit`` strings, chosen by their hash (with that
    of their ``place``, where repeated strings count): a table of at most len(ALPHABET + 1) ** 2 rows."""
    sample = bounded_sample(strings.select("s", *place), limit, "s", *place)
    rows = sample.select(F.explode(_pairs(F.col("s"))).alias("pair")).groupBy("pair").count().collect()
    return {r["pair"]: r["count"] for r in rows}


def _log_transitions(counts: dict[int, int], base: int) -> list[float]:
    """log P(second | first) with add-one smoothing, by pair code."""
    total = [base] * base
    for pair, n in counts.items():
        total[pair // base] += n
    return [math.log((counts.get(p, 0) + 1) / total[p // base]) for p in range(base * base)]


def train(docs: DataFrame, base: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> list[float] | None:
    """Log-likelihood ratio (random against ordinary) of every character pair, or None if
    the base patterns caught nothing to learn from."""
    caught = base.select(F.explode(F.concat(*[F.col(k)["value"] for k in KINDS])).alias("s"))
    random = _pair_counts(caught.distinct(), sample_strings)      # one string may be everywhere
    if not random:
        return None
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    texts = saved(bounded_sample(texts, sample_docs, "doc_id"), "sample")
    caught_here = F.lit(False)
    for pattern, _, _, test in KINDS.values():
        caught_here = caught_here | F.col("t").rlike(test)
    words = texts.filter(~caught_here).select("doc_id", F.posexplode(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))).alias("place", "s"))
    ordinary = _pair_counts(words, sample_strings, "doc_id", "place")
    size = len(ALPHABET) + 1
    return [a - b for a, b in zip(_log_transitions(random, size), _log_transitions(ordinary, size), strict=True)]


def _tagged(kind: str, number: int) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO,
         min_mean: float = MIN_MEAN, **samples: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random and ``spans``, an
    array<struct<start, kind_no, end, kind>> sorted by start, then kind as listed."""
    base = saved(base_spans(docs, id_col, text_col), "base-spans")
    ratio = train(docs, base, text_col, id_col, **samples)
    if ratio is None:
        base = base.withColumn("random", F.array().cast("array<struct<start:int,end:int,value:string>>"))
    else:
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")   # folded to one literal
        score = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda a, p: a + F.element_at(table, p + 1))
        judged = F.transform(_rests(F.col("runs"), [F.col(k) for k in KINDS]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value"), score(r["value"]).alias("ratio")))
        random = F.filter(judged, lambda r: (r["ratio"] >= min_ratio) & (r["ratio"] >= min_mean * (r["end"] - r["start"] - 1)))
        base = base.withColumn("random", F.transform(random, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value"))))
    tagged = [_tagged(k, i) for i, k in enumerate(NAMES)]
    return base.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in NAMES], F.array_sort(F.concat(*tagged)).alias("spans"))


def span_list(spans_col: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
