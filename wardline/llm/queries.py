"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import chat, decontaminate, lexical, near_dup, passages, pieces, pii, quality_model, quality_rules, secrets, substrings, toxicity, variants
from wardline.llm.common import read
from wardline.llm.sql import ORACLE  # noqa: F401  (the SQL of the queries that have one)

QUERIES: dict = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
            .select("doc_id", "held_out", "score", "predicted", "n_hits"))


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality_rules.quality_rules(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept"))


@register
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


@register
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


@register
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


@register
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
            .select("doc_id", "item_id", "start", "length", "similarity"))


@register
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


@register
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


#: Tools of the stand-in messages.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "convert": {"type": "object", "required": ["value"], "properties": {"value": {"type": "string"},
                "mode": {"type": "string", "enum": ["words", "lines"]}}},
}


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in messages with tool calls: assistant turns call a tool about
    their whole text, later user turns are also given as its results."""
    c = read(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0))
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    query = F.to_json(F.struct(F.col("text").alias("query"), (n % 60).alias("limit")))
    value = F.to_json(F.struct(
        F.struct(F.when(n % 11 == 0, name(F.col("turn") + 2)).otherwise(name(F.col("turn") - 2)).alias("$call")).alias("value"),
        F.element_at(F.array(F.lit("words"), F.lit("lines"), F.lit("bytes")), (n % 3 + 1).cast("int")).alias("mode")))
    search = (n % 2 == 0) | (F.col("turn") < 3)
    call = F.struct(name(F.col("turn")).alias("id"), F.when(search, "search").otherwise("convert").alias("name"),
                    F.when(search, query).otherwise(value).alias("arguments"))
    spoken = c.select("conv_id", "turn", "role", "text",
                      F.when(F.col("role") == "assistant", F.to_json(F.array(call))).alias("tool_calls"),
                      F.lit(None).cast("string").alias("call_id"))
    results = c.where((F.col("role") == "user") & (F.col("turn") > 1)).select(
        "conv_id", "turn", F.lit("tool").alias("role"), "text", F.lit(None).cast("string").alias("tool_calls"),
        name(F.col("turn") - 1).alias("call_id"))
    return spoken.unionByName(results)


@register
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(chat_messages(spark, sf_dir), TOOLS)


@register
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality_model.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
            .select("doc_id", "p", "site", "score", "kept"))


@register
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(read(spark, sf_dir, "documents"))


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


@register
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=10)
