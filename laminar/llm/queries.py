"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linecrf, mixing, ogg, packing, periodicruns, pii, secretscan, simhash, spelling, tokencount, tokenfile, warc, zstdquality
from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(documents(spark, sf_dir)).drop("found")


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.capture_histories(pages)
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return index.select(*first, *[c for c in index.columns if c not in first])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ogg.media_features(documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = zstdquality.score(docs, zstdquality.fit(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", zstdquality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir)).drop("found")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = linecrf.judge(docs, linecrf.fit(docs, _labels(spark, sf_dir)))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "content_share", "n_content_lines")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodicruns.with_tandem_repeats(documents(spark, sf_dir))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    digests = [F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return periodicruns.periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli", *digests)


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(documents(spark, sf_dir), damage=199), least_length=6, least_count=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_warc_index_merge, op3_token_counts, op4_simhash_near_dedup, op5_ogg_media, op6_compression_classifier, op7_packing, op8_bootstrapped_pii, op9_mixing, op10_line_crf, op11_periodic_runs, op12_token_file, op13_spelling_variants, pipeline)}

#: None of the results is one of SQL alone: they hold model scores, archive places, token ids,
#: XXH64 fingerprints or hashed samples. Tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {}
