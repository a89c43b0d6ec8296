"""The registered queries of this folder, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    byte_bpe,
    chat_turns,
    decontaminate,
    exact_dedup,
    quality_gam,
    quality_rules,
    sanitise,
    simhash,
    spelling_variants,
    suffix_dedup,
    token_alignment,
    token_counts,
    url_filter,
)
from codeloom.llm.common import checkpointed, table
from codeloom.llm.oracle import ORACLE


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "stays")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op6_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_turns.chat_turns(table(spark, sf_dir, "conversations")).drop("place")


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.span_digest(sanitise.personal_spans(table(spark, sf_dir, "documents")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("text_hash", "text_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = token_alignment.aligned(table(spark, sf_dir, "documents"), a, b).withColumn("row", F.monotonically_increasing_id())
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    rows = checkpointed(rows.withColumn("groups_sha256", digest).drop("groups"))
    return token_alignment.link_sums(rows).drop("row")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_simhash, op3_decontamination, op4_quality_rules, op5_url_filter, op6_chat_turns,
        op7_quality_gam, op8_token_counts, op9_sanitise, op10_byte_bpe, op11_exact_dedup, op12_spelling_variants,
    op13_token_alignment,
    )
}

__all__ = ["ORACLE", "QUERIES"]
