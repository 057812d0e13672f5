"""From raw documents to token digests: filters, near-duplicates, decontamination, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import bpe, decontam, langid, simhash, toxicity
from panelwright.llm.queries import DIFFERING, SHINGLE, TOXIC
from panelwright.session import materialise

#: A document goes if no language is told (`und`), or none with at least this mean probability.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text or letters, or in no language that was learned."""
    return langid.keep_identified(docs, LEAST_LANGUAGE_SCORE)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxic window."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    return simhash.keep_one(docs, SHINGLE, DIFFERING)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is covered by benchmark passages."""
    return decontam.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("toxicity", clean),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", encoded),
]

#: Trained networks and links between fingerprints are beyond SQL; the tests hold the stages after
#: the two networks against plain Python, taking what the networks kept as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
