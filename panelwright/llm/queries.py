"""Registered queries of the subpackage: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import (
    bpe,
    decontam,
    htmlmain,
    langid,
    phrases,
    pii,
    records,
    runs,
    sharding,
    simhash,
    topk,
    toxicity,
    warc,
)
from panelwright.llm.oracles import ORACLES

SHARDS = 40
END_ID = 2
TOXIC = 0.7
SHINGLE, DIFFERING = 4, 4
LEAST_RUN, LEAST_PERIODS = 24, 3
LEAST_PHRASE, FIRST_PHRASES = 100, 2000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), TOXIC)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), SHINGLE, DIFFERING)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding"), 256).alias("w"))
    return topk.top_k(rows, F.col("id") % 50 == 0, 5)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return records.packed_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, END_ID)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = documents.withColumn("text", runs.planted(F.col("doc_id"), F.col("text")))
    return runs.digest(runs.detect(changed, LEAST_RUN, LEAST_PERIODS))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), LEAST_PHRASE, FIRST_PHRASES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language,
        op2_shards,
        op3_main_text,
        op4_toxicity,
        op5_simhash,
        op6_top_k,
        op7_warc,
        op8_decontamination,
        op9_bpe,
        op10_records,
        op11_pii,
        op12_runs,
        op13_phrases,
    )
}

__all__ = ["ORACLES", "QUERIES"]
