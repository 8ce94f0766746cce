"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
lower-cased.  A test window is ``n`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.  The distinct windows form a table keyed by a
64-bit hash that is broadcast when its counted size is within ``BROADCAST_WINDOWS`` and
``BROADCAST_BYTES``, and shuffled otherwise.  Every training text is scanned once: one row (row, place, hash) per
word position and window length, without the text, is joined on the hash.  The words of
the rows with hits, and of no others, meet their hits in a join by row, where each is
verified word by word.  Hits repeat the windows' texts: their file is a hundredth of what
they are in memory, so they are never left to the planner's size check, but always shuffled.

The scan hashes words lower-cased in full (fast), which can only add candidates; the
verification lower-cases A-Z alone, as the rule says.

Defined cases: null or wordless texts have no windows and no hits; wordless items match
nothing and are not reported; repeated items count one by one; rows with the same id
stay separate rows; empty tables on either side work; other columns are ignored; the
work grows in proportion to the length of a text, which must fit a row (2 GB).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm.common import fresh, quoted, saved

N_WORDS = 13
#: a document is contaminated from one hit word in this many words
SHARE = 20
#: distinct test windows that are broadcast (about 200 bytes each); beyond, they are shuffled
BROADCAST_WINDOWS = 100_000
#: bytes of windows and their items in memory beyond which they are shuffled in any case
BROADCAST_BYTES = 64 << 20
#: numbers of rows with hits beyond which they are shuffled
BROADCAST_ROWS = 1 << 20

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in their original case (none for null)."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def _scan_key(window: Column) -> Column:
    return F.xxhash64(window)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan_keys(w: Column, lens: list[int]) -> Column:
    """Hashes of the windows of each length, one length after the other."""
    def of_length(folded: Column, n: int) -> Column:
        starts = F.when(F.size(folded) >= n, F.sequence(F.lit(1), F.size(folded) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: _scan_key(F.slice(folded, i, n)))
    return _let(F.transform(w, lambda x: F.lower(x)), lambda folded: F.concat(*[of_length(folded, n) for n in lens]))


def benchmark_windows(benchmark: DataFrame, n: int = N_WORDS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, len, window, items): the distinct windows, their scan hash and their items."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    one = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("i")
    part = w.select("item", "w", length.alias("len"), one).withColumn("part", F.slice("w", F.col("i"), F.col("len")))
    folded = F.transform("part", lambda x: F.lower(x))
    return (part.select("item", "len", _scan_key(folded).alias("key"),
                        F.translate(F.array_join("part", " "), UPPER, LOWER).alias("window"))
            .groupBy("key", "len", "window").agg(F.collect_set("item").alias("items")))


def _held(windows: DataFrame) -> tuple[int, int]:
    """(windows, about their bytes in memory); the file of a table does not tell the latter."""
    items = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 24)
    n, size = windows.agg(F.count("*"), F.sum(F.octet_length("window") + items + 100)).first()
    return n, size or 0


def matches(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (ids as sorted strings), spans
    (merged hit word ranges, end exclusive) and contaminated."""
    windows = saved(benchmark_windows(benchmark, n, item_col, item_text_col), "windows")
    lens = sorted(r["len"] for r in windows.select("len").distinct().collect())      # n values at most
    n_windows, held = _held(windows)
    few = n_windows <= broadcast_windows and held <= BROADCAST_BYTES
    d = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("w"))
    d = saved(d.withColumn("n_words", F.size("w").cast("long")), "words")
    keys = _scan_keys(F.col("w"), lens) if lens else F.array().cast("array<bigint>")
    places = d.select("row", F.size("w").alias("n"), F.posexplode(keys).alias("p", "key"))
    t = windows.select(F.col("key").alias("t_key"), F.col("len").alias("t_len"), "window", "items")
    t = F.broadcast(t) if few else t.hint("merge") if held > BROADCAST_BYTES else t
    hit = places.join(t, F.col("key") == F.col("t_key"))
    # place in the list of hashes -> window length and first word
    begin, length, at = F.lit(0), F.lit(0), F.lit(0)
    for ln in lens:
        inside = F.col("p") >= at
        begin, length = F.when(inside, F.col("p") - at).otherwise(begin), F.when(inside, F.lit(ln)).otherwise(length)
        at = at + F.greatest(F.col("n") - ln + 1, F.lit(0))
    hit = hit.withColumn("begin", begin).withColumn("len", length).filter(F.col("len") == F.col("t_len"))
    hit = saved(hit.groupBy(F.col("row").alias("hit_row")).agg(F.collect_list(F.struct("begin", "len", "window", "items")).alias("met")), "hits")
    # only rows with hits take their words along: their numbers are a written table of known
    # size, which the planner broadcasts, or shuffles each text once for beyond its threshold
    rows = saved(hit.select("hit_row"), "hit-rows")
    rows = rows if rows.count() <= BROADCAST_ROWS else rows.hint("merge")
    texts = d.join(rows, F.col("row") == F.col("hit_row"), "left_semi").select(F.col("row").alias("text_row"), "w")
    same = lambda x: F.translate(F.array_join(F.slice("w", x["begin"] + 1, x["len"]), " "), UPPER, LOWER) == x["window"]
    found = texts.join(hit.hint("merge"), F.col("text_row") == F.col("hit_row")).select("text_row", F.filter("met", same).alias("found"))
    none = F.array().cast(dict(found.dtypes)["found"])
    per = (d.select("row", "doc_id", "n_words").join(found.hint("merge"), F.col("row") == F.col("text_row"), "left")
           .select("row", "doc_id", "n_words", F.coalesce("found", none).alias("found")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["begin"], x["begin"] + x["len"] - 1)))))
    per = per.withColumn("covered", covered)
    after = F.transform("covered", lambda p: p + 1)
    # a run starts where the word before is not covered and ends before the first that is not
    spans = F.zip_with(F.array_except("covered", after), F.array_except(after, "covered"), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))))
    return (per.select("row", "doc_id", "n_words", F.size("covered").cast("long").alias("n_hit"), items.alias("items"), spans.alias("spans"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (mode "documents"), or with the hit words cut
    out of every text (mode "spans").  All columns of ``docs`` are kept."""
    row, gone, hits = fresh(docs, "dec_row", "dec_gone", "dec_spans")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    renamed = numbered.select(F.col(row).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    m = matches(renamed, benchmark, **options).filter("n_hit > 0")
    if mode == "documents":
        bad = m.filter("contaminated").select(F.col("doc_id").alias(row))
        return numbered.join(bad, row, "left_anti").select(*quoted(docs))
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    m = m.select(F.col("doc_id").alias(row), F.col("spans").alias(hits))
    out = numbered.join(m, row, "left")
    text = F.col(f"`{text_col}`")
    w, between = words(text), F.split(text, SEPARATORS.replace("[", "[^", 1))
    cut = F.transform(w, lambda x, i: F.when(F.exists(F.col(hits), lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")).otherwise(x))
    joined = F.array_join(F.flatten(F.zip_with(between, cut, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return out.withColumn(gone, F.when(F.col(hits).isNull(), text).otherwise(joined)).select(
        *[F.col(gone).alias(c) if c == text_col else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
