"""The thin queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.llm import byte_bpe, chat_format, filter_audit, line_blocks, line_quality, merkle_manifest, mph_dedup, pii_crf, quality_rules, simhash_gray, source_mixing, token_rollups, toxicity
from veracol.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.counted(table(spark, sf_dir, "documents"))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollups.maintained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extracted(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"))
    return rows.withColumn("failed_rules", F.array_join("failed_rules", "|"))


def op7_mph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mph_dedup.grouped(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat_format.read_back(chat_format.formatted(turns, *vocabulary), *vocabulary)


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.grouped(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii_crf": op2_pii_crf,
    "op3_token_rollups": op3_token_rollups,
    "op4_line_blocks": op4_line_blocks,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_mph_dedup": op7_mph_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_simhash_gray": op9_simhash_gray,
    "op10_source_mixing": op10_source_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_quality": op12_line_quality,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op3_token_rollups": token_rollups.ORACLE,
    "op6_quality_rules": quality_rules.oracle(),
    "op7_mph_dedup": mph_dedup.ORACLE,
    "op10_source_mixing": source_mixing.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_merkle_manifest": merkle_manifest.oracle(),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
