"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. The first drops the documents that the rules or their hosts' verdicts reject; the second
thins texts and drops no document, counting copies of a text as one page; the third keeps one document of each group of near duplicates (five
words, 0.8), the one with the smallest doc_id; the fourth deals out each document at least once, those of
small sources up to twice; the last returns the ids of every text.

Defined cases: see each operator; an empty table passes through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import bpe, linededup, mixing, near, quality
from cellweave.llm.common import table
from cellweave.shared import removed, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.rules_filter(docs)


#: Copies are still there, for near_dedup: they count as one page, and no page loses more than half to boilerplate.
COPIES_STAY = linededup.Limits(by_text=True, most_lost=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.lines_filter(docs, COPIES_STAY)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of 1,000 rows: some 4 MB of them, not 40."""
    spark.conf.set(BATCH, "1000")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near.one_of_each(docs, near.Likeness(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    small_batches(spark)
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: SQL can't express byte pair merging; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again.

    A stage's table goes when the next one is written; the last one stays, as the result is read from it.
    The session's batch size is as before in the end.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    batch, before = spark.conf.get(BATCH), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            out = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
            if before:
                removed(spark, before)
            before = out
    finally:
        spark.conf.set(BATCH, batch)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
