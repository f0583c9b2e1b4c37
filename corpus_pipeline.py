"""A corpus pipeline: quality rules, near-duplicate removal, secret scan, mixing, packing.

Each stage reads what the stage before has kept, and all but the last return the
columns of `documents`. `run` deletes what a stage has written once the next one is done.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.llm import linecrf, mixing, packing, secretscan, simhash
from laminar.llm.common import documents
from laminar.sources.shared import fresh_path, remove, scratch

#: Texts that Python workers are handed at a time; documents are long, so batches of the default size take much memory.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    rows = min(BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    small_batches(spark)
    model = linecrf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return linecrf.passing(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    small_batches(spark)
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    small_batches(spark)
    return secretscan.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resample(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mixing_sources),
    ("packing", packing_sequences),
]

#: Stages score, hash, sample and tokenize: not for SQL. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
