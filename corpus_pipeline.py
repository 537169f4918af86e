"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

run() returns the rows of documents that are left, with the columns of documents,
shard and slot.  Scores, hashes and random permutations have no SQL form, so there
is no ORACLE_SQL; tests/llm holds the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from factloom.llm.common import materialise, table

ORACLE_SQL = None


#: Rows that a Python worker is handed at once: whole texts are in them, and two workers share an executor's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores below 0.5.

    Null and empty texts have the score of the bias alone, and stay.  Repeated rows are scored each.
    """
    small_batches(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 Jaccard over five-word shingles.

    Rows without words stay, as do rows without id."""
    small_batches(spark)
    return ngram_join.keep_one(docs, width=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (0.8 of its five-word shingles).

    Null and empty texts stay, as do rows without id; rows with the same id go together."""
    small_batches(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to 1.5 times as often as the largest."""
    return mixing.mix(docs, annotate=False, repetition_limit=1.5)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts, uniformly shuffled; no row is looked into."""
    small_batches(spark)
    return sharding.shard(docs, 8)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
