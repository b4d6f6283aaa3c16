"""Corpus pipeline: stages over ``documents``, each written and read again.

1. language ID: documents whose language cannot be told go: texts without a
   letter, and texts that score far below the training texts of their length in
   the nearest language;
2. n-gram Jaccard join: of each group of near copies the smallest id stays;
3. benchmark decontamination: documents that share a window with an item go;
4. PII: entities in the text are replaced by surrogates, ``n_chars`` follows;
5. BPE: documents are encoded; the last stage returns (doc_id, lang, source, ids,
   n_tokens, text), with the text decoded from the ids.

All stages but the last return the columns of ``documents``, and further columns
if the input has them.  Rows with null ids, null texts and repeated rows pass
through the stages as the operators define it; a null text ends in the first.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontam, langid, ngram_join, pii
from riskloom.llm.common import prepare, read_table, stored

# A text in no learned language shares few of the ranked n-grams: its score is near 0.
LEAST_SCORE = 0.2  # highest bar; scripts with many letters and short texts have lower ones
LOW_SHARE, FAR = 0.05, 0.5  # bar: FAR times the score that LOW_SHARE of the language's training texts stay under


def _rows(docs: DataFrame, *without: str) -> DataFrame:
    """(row, body): all columns in one value, which operators pass on as the id, and the text."""
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns if c not in without]).alias("row"), docs["text"].alias("body")
    )


def _length_class(text: Column) -> Column:
    """Texts of one class differ in length by less than a factor of two."""
    return F.floor(F.log2(F.length(text) + 1)).cast("int")


def score_bars(docs: DataFrame, profiles: dict[str, list[int]]) -> tuple[DataFrame, DataFrame]:
    """(lang_pred, class, bar) from the training texts that are told as their own
    language, and (lang_pred, low) with the lowest bar, for lengths they lack."""
    rows = langid.training_rows(docs).where("lang is not null and text is not null")
    label = F.struct(rows["lang"].cast("string").alias("own"), _length_class(rows["text"]).alias("class"))
    told = langid.predict(rows.select(label.alias("label"), rows["text"].alias("body")), profiles, "label", "body")
    low = F.percentile_approx("score", LOW_SHARE, 1000) * FAR
    bars = stored(
        told.where(F.col("doc_id.own") == F.col("lang_pred"))
        .groupBy("lang_pred", F.col("doc_id.class").alias("class"))
        .agg(F.least(low, F.lit(LEAST_SCORE)).alias("bar"))
    )
    return bars, bars.groupBy("lang_pred").agg(F.min("bar").alias("low"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; profiles come from the labelled rows of ``docs``."""
    prepare(spark)
    profiles = langid.fit(langid.training_rows(docs))
    told = langid.predict(_rows(docs), profiles, "row", "body")
    bars, lowest = score_bars(docs, profiles)
    told = told.where("lang_pred != 'und'").withColumn("class", _length_class(F.col("doc_id.text")))
    told = told.join(F.broadcast(bars), ["lang_pred", "class"], "left").join(F.broadcast(lowest), "lang_pred", "left")
    return told.where(F.col("score") >= F.coalesce("bar", "low", F.lit(LEAST_SCORE))).select("doc_id.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id.

    Rows with equal ids are told apart by their text; rows that equal each other in
    both are one document.
    """
    prepare(spark)
    named = docs.withColumn("row_name", F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("h")))
    found = stored(ngram_join.components(named, "row_name"))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    keep = keep.select(F.col("doc_id").alias("kept_name"))
    out = named.join(keep, F.col("row_name").eqNullSafe(F.col("kept_name")), "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["row_name"])
    return out.drop("row_name")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a window of any benchmark item."""
    found = decontam.annotate(_rows(docs), read_table(spark, sf_dir, "benchmark"), "row", "body")
    return found.where(F.size("spans") == 0).select("doc_id.*")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    prepare(spark)
    done = pii.anonymise(_rows(docs, "text"), id_col="row", text_col="body").select("doc_id.*", "text")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text decoded from them."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    row = docs.select(F.struct("doc_id", "lang", "source").alias("row"), docs["text"].alias("body"))
    both = bpe.round_trip_texts(row, path, "row", "body")
    return both.select("doc_id.*", "ids", "n_tokens", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminated),
    ("pii", without_pii),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to ``documents``; each result is written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


# Profiles, surrogates and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
