"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopweave.llm import ann, decontam, lines, mixing, neardup, oracles, pii, quality, sharding, substring, toxicity
from stopweave.llm.store import table


def op1_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_deletion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.decontaminate(docs, items))


def op4_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_substrings(table(spark, sf_dir, "documents")))


def op5_additive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op6_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxic_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_positive_unlabelled": op1_positive_unlabelled,
        "op2_deletion_join": op2_deletion_join,
        "op3_positional_index": op3_positional_index,
        "op4_count_min": op4_count_min,
        "op5_additive_codes": op5_additive_codes,
        "op6_super_minhash": op6_super_minhash,
        "op7_toxic_convnet": op7_toxic_convnet,
        "op8_shard_tree": op8_shard_tree,
        "op9_disguised_pii": op9_disguised_pii,
        "op10_mix_sources": op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
