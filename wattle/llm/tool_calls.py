"""Chat formatting: link tool calls and results, order, validate and serialise them.

* Calls and results meet in a hash join by (conversation, call id); both sides are
  reduced to one row per id first, so a repeated id cannot multiply rows.
* Order: a call must follow the calls that it builds on (``after``).  Where every such
  reference points back, the position in the transcript is such an order already (wave
  0).  Only calls that build, directly or not, on a reference that points forward are
  peeled in waves (a wave holds the calls whose references are all placed), by joins
  over the small remainder.  Calls on a cycle, or behind one, are never placed.
* Arguments are checked against a schema for each tool (required keys, types, unknown
  keys) with variant functions.
* The record of a call is canonical JSON: keys sorted, no blanks, numbers in shortest
  form (variant objects keep their keys sorted).

Ranks within a conversation come from counts of (conversation, wave, stretch of turns)
groups, so a huge conversation is not sorted in one task.

Defined cases: a result without a call and a call without a result are kept and marked;
of calls (or results) with the same id in a conversation the first counts, the number is
reported; a call without an id and a result that names no call (role ``tool``) are rows
of their own, tagged ``id:missing``, never linked and without a place in the order, since
no reference can name them; null or malformed arguments are invalid; a reference to an unknown id, or of a
call to itself, is dropped from the order and reported; null conversation ids form one
conversation; empty tables work; other columns are ignored.  An integer is a number
without a fraction, of up to 38 digits and without an exponent; numbers beyond that are
of type number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.llm.common import saved

#: tool -> argument -> (JSON types that are allowed, required)
SCHEMAS: dict[str, dict[str, tuple[tuple[str, ...], bool]]] = {
    "search": {"query": (("string",), True), "limit": (("integer",), True), "exact": (("boolean",), False)},
    "summarise": {"text": (("string",), True), "max_words": (("integer",), True), "ratio": (("integer", "number"), False)},
    "translate": {"text": (("string",), True), "target": (("string",), True), "options": (("object",), False)},
}
STRETCH = 1 << 16


def _json_type(v: Column) -> Column:
    s = F.schema_of_variant(v)
    whole = s.startswith("DECIMAL") & F.to_json(v).rlike("^-?[0-9]+$")       # also beyond 64 bits
    return (F.when((s == "BIGINT") | whole, "integer").when(s.startswith("DECIMAL") | (s == "DOUBLE"), "number")
            .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object")
            .when(s.startswith("ARRAY"), "array").otherwise("null"))


def argument_errors(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted array of what is wrong with a call's arguments (empty: valid)."""
    v = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    per_tool = F.when(F.lit(False), none)
    for tool, keys in schemas.items():
        checks = []
        for key, (types, required) in keys.items():
            at = F.try_variant_get(v, f"$['{key}']", "variant")
            kind = _json_type(at)
            wrong = F.when(~kind.isin(*types), F.lit(f"type:{key}"))
            checks.append(F.when(at.isNull(), F.lit(f"missing:{key}") if required else F.lit(None)).otherwise(wrong))
        given = F.json_object_keys(F.to_json(v))
        unknown = F.transform(F.array_except(given, F.array(*[F.lit(k) for k in keys])), lambda k: F.concat(F.lit("unknown:"), k))
        per_tool = per_tool.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*checks)), unknown)))
    known = F.coalesce(name.isin(*schemas), F.lit(False))
    return (F.when(v.isNull() | ~F.coalesce(is_object, F.lit(False)), F.array(F.lit("arguments:malformed")))
            .when(~known, F.array(F.lit("tool:unknown"))).otherwise(per_tool))


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text, null if it is malformed."""
    return F.to_json(F.try_parse_json(json))


def _waves(calls: DataFrame) -> DataFrame:
    """(conv, id, wave) of the calls that do not keep wave 0; wave is null on or behind a cycle."""
    pos = calls.select("conv", "id", F.struct("turn", "idx").alias("pos"))
    ref = calls.select("conv", "id", F.struct("turn", "idx").alias("pos"), F.explode("refs").alias("ref"))
    pos = pos.select(F.col("conv").alias("c"), F.col("id").alias("r"), F.col("pos").alias("ref_pos"))
    ref = ref.join(pos, F.col("conv").eqNullSafe(F.col("c")) & (F.col("ref") == F.col("r")))
    edges = saved(ref.select("conv", "id", "ref", (F.col("ref_pos") > F.col("pos")).alias("forward")), "edges")
    affected = saved(edges.filter("forward").select("conv", "id").distinct(), "affected")
    front = affected
    while not front.isEmpty():                     # what builds on an affected call is affected
        f = front.select(F.col("conv").alias("c"), F.col("id").alias("r"))
        step = edges.join(f, F.col("conv").eqNullSafe(F.col("c")) & (F.col("ref") == F.col("r")), "left_semi").select("conv", "id").distinct()
        front = saved(_minus(step, affected), "front")
        affected = saved(affected.unionByName(front), "affected")
    placed = affected.limit(0).withColumn("wave", F.lit(0))
    left, wave = affected, 0
    while not left.isEmpty():
        wave += 1
        r = left.select(F.col("conv").alias("c"), F.col("id").alias("r"))
        waiting = edges.join(r, F.col("conv").eqNullSafe(F.col("c")) & (F.col("ref") == F.col("r")), "left_semi").select("conv", "id").distinct()
        free = saved(_minus(left, waiting), "free")
        if free.isEmpty():
            break
        placed = placed.unionByName(free.withColumn("wave", F.lit(wave)))
        left = saved(_minus(left, free), "left")
    return placed.unionByName(left.withColumn("wave", F.lit(None).cast("int")))


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    return a.join(b, F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left_anti")


def _nameless(calls: DataFrame, messages: DataFrame, schemas: dict) -> DataFrame:
    """Rows of the calls without an id and of the results that name no call."""
    missing = F.array(F.lit("id:missing"))
    count = lambda n: F.lit(n).cast("long")
    same = lambda name, idx: [F.col("conv"), F.lit(None).cast("string").alias("id"), F.col("turn"), idx.cast("int").alias("idx"),
                              *[count(int(x == name)).alias(x) for x in ("n_calls", "n_results")], F.lit(False).alias("linked")]
    a = calls.filter("id IS NULL").select(*same("n_calls", F.col("idx")), F.concat(missing, argument_errors(F.col("name"), F.col("arguments"), schemas)).alias("errors"),
                                          "name", "arguments")
    r = messages.filter("role = 'tool' AND result_for IS NULL").withColumn("conv", F.col("conv").cast("string")).withColumn("turn", F.col("turn").cast("long"))
    r = r.select(*same("n_results", F.lit(0)), F.concat(missing, F.array(F.lit("call:missing"))).alias("errors"), F.col("content").alias("result"))
    return a.unionByName(r, allowMissingColumns=True)


def format_tool_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call id (and per result without a call, and per call or result
    without an id) from messages (conv string,
    turn long, role string, content string, calls array<struct<id, name, arguments, after
    array<string>>>, result_for string): conv, id, turn, idx, wave, seq (place in the
    conversation's order, from 0; null if it has none), n_calls, n_results, linked, errors and json."""
    key = ["conv", "id"]
    every = (messages.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.posexplode("calls").alias("idx", "call"))
             .select("conv", "turn", "idx", F.col("call.id").alias("id"), "call.name", "call.arguments",
                     F.coalesce("call.after", F.array().cast("array<string>")).alias("after")))
    each = every.filter("id IS NOT NULL")
    calls = (each.groupBy(*key).agg(F.min(F.struct(F.col("turn").isNull(), "turn", "idx", "name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
             .select(*key, "n_calls", *[F.col(f"c.{x}") for x in ("turn", "idx", "name", "arguments", "after")]))
    calls = calls.withColumn("refs", F.array_remove(F.array_distinct(F.array_compact("after")), F.col("id")))
    calls = saved(calls, "calls")
    results = (messages.filter("result_for IS NOT NULL").select(F.col("conv").cast("string").alias("conv"), F.col("result_for").alias("id"),
                                                                F.col("turn").cast("long").alias("turn"), "content")
               .groupBy(*key).agg(F.min(F.struct(F.col("turn").isNull(), "turn", "content")).alias("r"), F.count("*").alias("n_results"))
               .select(F.col("conv").alias("r_conv"), F.col("id").alias("r_id"), "n_results", F.col("r.turn").alias("r_turn"), F.col("r.content").alias("result")))
    on = F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("id") == F.col("r_id"))
    both = calls.join(results, on, "full_outer")
    is_call = F.col("n_calls").isNotNull()
    waves = _waves(calls).select(F.col("conv").alias("w_conv"), F.col("id").alias("w_id"), "wave", F.lit(True).alias("moved"))
    both = (both.withColumn("conv", F.when(is_call, F.col("conv")).otherwise(F.col("r_conv"))).withColumn("id", F.coalesce("id", "r_id"))
            .withColumn("turn", F.coalesce("turn", "r_turn")).withColumn("idx", F.coalesce("idx", F.lit(0)))
            .join(waves, F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("id") == F.col("w_id")), "left")
            .withColumn("wave", F.when(F.col("moved").isNull(), F.lit(0)).otherwise(F.col("wave"))))
    known = calls.select(F.col("conv").alias("k_conv"), F.col("id").alias("k_id"))
    loose = (calls.select(*key, F.explode("after").alias("ref")).join(known, F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("ref") == F.col("k_id")), "left")
             .filter(F.col("k_id").isNull() | (F.col("ref") == F.col("id"))).groupBy(*key).agg(F.array_sort(F.collect_set("ref")).alias("loose"))
             .select(F.col("conv").alias("l_conv"), F.col("id").alias("l_id"), "loose"))
    both = both.join(loose, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("id") == F.col("l_id")), "left")
    tags = F.transform(F.coalesce("loose", F.array().cast("array<string>")), lambda r: F.concat(F.lit("reference:"), r))
    order = F.when(F.col("wave").isNull(), F.array(F.lit("order:cycle"))).otherwise(F.array().cast("array<string>"))
    errors = F.when(is_call, F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), tags, order)).otherwise(F.array(F.lit("call:missing")))
    both = saved(both.select(*key, "turn", "idx", "wave", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
                             (is_call & F.col("n_results").isNotNull()).alias("linked"), errors.alias("errors"), "name", "arguments", "result"), "linked")
    # place in the order: rows before the (wave, stretch) group, plus the rank inside it
    placed = both.filter("wave IS NOT NULL").withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    group = ["conv", "wave", "stretch"]
    per = placed.groupBy(*group).agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("wave", "stretch")) - F.col("n"))
    per = per.select(*[F.col(c).alias(f"p_{c}") for c in group], "before")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("turn", "idx", "id")) - 1
    placed = placed.withColumn("rank", rank).join(per, same).withColumn("seq", (F.col("rank") + F.col("before")).cast("long"))
    out = placed.select(*both.columns, "seq").unionByName(both.filter("wave IS NULL").withColumn("seq", F.lit(None).cast("long")))
    out = out.unionByName(_nameless(every, messages, schemas), allowMissingColumns=True)
    # arguments that parse go in as JSON, others as the text that was given
    record = F.to_json(F.struct("id", "name", F.when(F.try_parse_json("arguments").isNull(), F.col("arguments")).alias("raw_arguments"),
                                F.try_parse_json("arguments").alias("arguments"), "result", "errors", "seq"))
    return out.select(*key, "turn", "idx", "wave", "seq", "n_calls", "n_results", "linked", "errors", canonical(record).alias("json"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """``conversations`` read as tool use: a user turn is a call, an assistant's turn is
    the result (role ``tool``) of the turn before it; without a turn number neither has an id.  Tool, arguments and references follow from the text, so that every
    kind of case occurs: missing, mistyped and unknown arguments, malformed JSON,
    references that point back and forward, calls without a result."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    name_of = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("v")))
    quoted_text = F.substr(text, F.lit(6), F.char_length(text) - 6)
    name = F.element_at(F.array(F.lit("search"), F.lit("summarise"), F.lit("translate"), F.lit("lookup")), F.pmod(n, F.lit(13)) % 4 + 1)
    number = F.when(n % 7 == 0, F.concat(F.lit('"'), words.cast("string"), F.lit('"'))).otherwise(words.cast("string"))
    fields = (F.when(name == "search", F.concat(F.lit('{"query": '), quoted_text, F.lit(', "limit": '), number, F.lit(', "exact": true}')))
              .when(name == "summarise", F.concat(F.lit('{"max_words": '), number, F.lit(', "text": '), quoted_text, F.lit(', "ratio": 0.250}')))
              .when(name == "translate", F.concat(F.lit('{ "text": '), quoted_text, F.when(n % 5 == 0, F.lit("}")).otherwise(F.lit(', "target": "en", "options": {"b": 1, "a": [1, 2.0]}, "x": null}'))))
              .otherwise(F.concat(F.lit('{"q": '), quoted_text, F.lit(', '), F.when(n % 2 == 0, F.lit('"q2": 1}')).otherwise(F.lit("oops")))))
    after = (F.when(n % 11 == 0, F.array(name_of(F.col("turn") + 2))).when(n % 3 == 0, F.array(name_of(F.col("turn") - 2), name_of(F.col("turn") - 4)))
             .otherwise(F.array().cast("array<string>")))
    call = F.struct(name_of(F.col("turn")).alias("id"), name.alias("name"), fields.alias("arguments"), after.alias("after"))
    is_call = F.col("role") == "user"
    none = F.array().cast("array<struct<id:string,name:string,arguments:string,after:array<string>>>")
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role")
    return conversations.select(F.col("conv_id").cast("string").alias("conv"), "turn", role, F.col("text").alias("content"),
                                F.when(is_call, F.array(call)).otherwise(none).alias("calls"),
                                F.when(F.col("role") == "assistant", name_of(F.col("turn") - 1)).alias("result_for"))
