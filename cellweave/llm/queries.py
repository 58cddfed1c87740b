"""The registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, exact, importance, linededup, mixing, near, pagediff, passages, quality, secrets, simhash, toxicity
from .common import table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_runs(table(spark, sf_dir, "documents")).withColumnRenamed("sha", "text_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(table(spark, sf_dir, "pages"))


def op4_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), least=50)


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.thinned(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.withColumn("weight", F.round("weight", 9))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.linked(table(spark, sf_dir, "documents"), near.Likeness(words=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rules_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"), words=3, radius=3)


def op13_block_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = [op1_exact_content_sort, op2_secret_scan, op3_page_text, op4_repeated_units, op5_site_lines, op6_toxicity, op7_word_bpe, op8_temperature_mix, op9_jaccard_join, op10_quality_rules, op11_importance_resample, op12_simhash_covering, op13_block_clusters]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
