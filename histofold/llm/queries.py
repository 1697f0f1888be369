"""Registered queries of the llm operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histofold.llm import bpe, chat, exact_dedup, jaccard, language, packing, pii, quality, resampling, runs, substring, toxicity, url_filter
from histofold.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut(documents(spark, sf_dir).select("doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, *ranks), *ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked(documents(spark, sf_dir).select("doc_id", "text"), pii.session_key(spark))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.is_training(F.col("doc_id")))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", F.coalesce(~toxicity.is_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def _hex(text: Column, at: int) -> Column:
    """Four hexadecimal digits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are all pages, fetched on a day derived from their id; list events are derived from
    the hosts, their parent domains and first path segments that occur in the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(start, (F.col("page_id") % 366).cast("int")).alias("fetched"))
    seen = captures.select(F.explode(url_filter.patterns_of(F.col("url"))).alias("pattern")).distinct()
    name = F.concat_ws("", F.lit("list"), (_hex(F.col("pattern"), 1) % 3).cast("string"))
    # up to four changes each, switching on and off by turns
    events = seen.select("pattern", name.alias("list"), F.explode(F.sequence(F.lit(0), _hex(F.col("pattern"), 5) % 4)).alias("k")).select(
        "list", "pattern", (F.col("k") % 2 == 0).alias("active"),
        F.date_add(start, _hex(F.concat(F.col("pattern"), F.lit("#"), F.col("k").cast("string")), 9) % 60 + F.col("k") * 90).alias("time"))
    out = url_filter.judge(captures, events)
    return out.select("page_id", "fetched", "blocked", "n_lists", "matched", F.array_join("lists", ",").alias("lists"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(documents(spark, sf_dir))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a chosen one; its rejected twin has the words of its last assistant turn in
    reverse order (a conversation without assistant turns has an equal twin)."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    worse = turns.join(last, "conv_id", "left").select(
        "conv_id", "turn", "role", F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")),
                                          F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.col("text")).alias("text"))
    pairs = turns.select(F.col("conv_id").alias("chosen"), F.col("conv_id").alias("rejected")).dropna().distinct()
    out = chat.preferences(turns, pairs, rejected_turns=worse)
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("chosen_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected",
                      size("chosen_mask").alias("chosen_trained"), size("rejected_mask").alias("rejected_trained"),
                      F.size("chosen_mask").cast("long").alias("chosen_spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(documents(spark, sf_dir))


def planted_periods(docs: DataFrame) -> DataFrame:
    """Every text, those whose id hashes to a multiple of ten turned periodic from a derived word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(
        h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    at = cut.withColumn("n", F.size("words")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("array_join(transform(sequence(0, n - 1), i -> words[CASE WHEN i < a THEN i ELSE cast(a + (i - a) % p AS int) END]), ' ')")
    return at.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.collapsed(planted_periods(documents(spark, sf_dir))).withColumn("best", runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                      F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    training = toxicity.is_training(F.col("doc_id"))
    model = language.fit(docs, training)
    out = language.labelled(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(~training, F.lit(False)).alias("held_out"), "lang_pred", "score",
                      F.size("spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_packing, op3_line_frequency, op4_bpe, op5_pii_surrogates, op6_compression_toxicity,
        op7_url_filter, op8_jaccard_join, op9_preference_format, op10_exact_dedup, op11_periodic_runs,
        op12_importance_resampling, op13_crf_language)
}
