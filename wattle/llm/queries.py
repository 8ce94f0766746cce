"""Thin registered queries: each applies one operator with its production
parameters to its whole table and derives the digest columns from the
operator's real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.llm import secrets, tool_calls, toxicity
from wattle.llm.common import documents, sorted_digest
from wattle.llm.decontaminate import matches
from wattle.llm.exact_dedup import exact_dedup
from wattle.llm.line_dedup import line_dedup
from wattle.llm.merkle import proofs
from wattle.llm.mixture import mixture
from wattle.llm.near_dup import near_duplicates
from wattle.llm.substring_dedup import substring_dedup
from wattle.llm.suffix_dedup import suffix_dedup
from wattle.llm.token_align import align
from wattle.llm.url_filter import filter_urls


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text", "source"), counts=("n_lines", "n_removed"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    sorted_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = tool_calls.format_tool_calls(tool_calls.transcripts(talk))
    return out.select(F.col("conv").cast("long").alias("conv_id"), "id", "turn", "wave", "seq", "n_calls", "n_results", "linked",
                      F.array_join("errors", ",").alias("errors"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.KINDS))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"),
                      secrets.span_list(F.col("spans")).alias("spans"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_line_dedup, op4_exact_dedup, op5_decontaminate,
                            op6_tool_calls, op7_substring_dedup, op8_near_dup, op9_secrets, op10_mixture, op11_merkle_manifest,
                            op12_token_alignment, op13_url_filter)
}
