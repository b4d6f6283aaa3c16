"""Registered queries of the subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontam, langid, license_scan, negatives, ngram_join, pii, quality, repair, reshard, rpforest, suffix,
    token_files,
)
from .common import read_table


def op1_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = langid.fit(langid.training_rows(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return langid.predict(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.repeats(read_table(spark, sf_dir, "documents")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read_table(spark, sf_dir, "documents"))


def op4_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_files.tokens_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.reshard_digest(read_table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.anonymise(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.annotate(docs, items))


def op11_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read_table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rank_order_language": op1_rank_order_language,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_byte_cnn_quality": op4_byte_cnn_quality,
        "op5_token_files": op5_token_files,
        "op6_min_cost_flow_resharding": op6_min_cost_flow_resharding,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_bpe_round_trip": op8_bpe_round_trip,
        "op9_projection_forest": op9_projection_forest,
        "op10_winnowing_decontamination": op10_winnowing_decontamination,
        "op11_anchor_tree_negatives": op11_anchor_tree_negatives,
        "op12_license_scan": op12_license_scan,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_winnowing_decontamination": decontam.ORACLE,
        "op11_anchor_tree_negatives": negatives.ORACLE,
        "op12_license_scan": license_scan.ORACLE,
    }
