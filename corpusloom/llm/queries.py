"""Queries of the nine problems, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, copies, groups, language, neardup, packing, sentences, text_ops


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.found(_t(spark, d, "corpus_strict"), _t(spark, d, "vidgen_pairs"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return groups.assign(_t(spark, d, "corpus_strict"), _t(spark, d, "vidgen_pairs"), _t(spark, d, "split_ratios"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return text_ops.look_alike_rows(_t(spark, d, "corpus_strict"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return text_ops.character_forms(_t(spark, d, "corpus_strict"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return text_ops.skeleton_groups(_t(spark, d, "corpus_strict"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return text_ops.repairs(_t(spark, d, "corpus_strict")).select("id")


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    return text_ops.repairs(_t(spark, d, "corpus_strict"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found(_t(spark, d, "corpus_strict"))


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_t(spark, d, "corpus_strict"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(_t(spark, d, "corpus_strict"))


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(_t(spark, d, "corpus_strict"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(_t(spark, d, "corpus_strict"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return neardup.clusters(_t(spark, d, "corpus_strict"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): every text as decoded from its ids; a null text comes back empty."""
    return bpe.decode(bpe.encode(_t(spark, d, "documents"))).withColumnRenamed("id", "doc_id")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    sized = bpe.token_counts(_t(spark, d, "documents"))
    return packing.packing(sized, _t(spark, d, "token_budgets")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packing(spark, d), _t(spark, d, "token_budgets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.boundaries(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}
