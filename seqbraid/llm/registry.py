"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqbraid.llm import decontaminate, language_id, lm_scoring, near_dedup, quality_fm, quality_rules, secret_scan, sentencepieces, token_files, warc
from seqbraid.plans import ship

#: Vocabularies of the public tokenizers.
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship.ensure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(_table(spark, sf_dir, "documents"), PIECE_BPE, with_ids=False)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", k=3, num=85, den=100)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), PIECE_BPE, learned=True)


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(_table(spark, sf_dir, "pages"), min_bytes=0)


def queries() -> dict[str, Query]:
    each = (
        op1_quality_rules,
        op2_language_id,
        op3_token_files,
        op4_sentencepiece,
        op5_near_dedup,
        op6_lm_scoring,
        op7_quality_fm,
        op8_secret_scan,
        op9_decontaminate,
        op10_warc,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": near_dedup.near_duplicates_sql(), "op8_secret_scan": secret_scan.report_sql(), "op10_warc": warc.deduplicated_sql()}
