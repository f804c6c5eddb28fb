"""A corpus from raw documents: language, quality, near-duplicates, benchmark passages, packed sequences.

Each stage works on all the rows the one before kept, as written and reread.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshtally.llm import decontaminate, language, packing, quality, simhash
from meshtally.llm.common import ready
from meshtally.session import settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language; texts that are NULL, without letters, or not surely in one go."""
    ready(spark)
    return language.known_language(docs, language.fit(language.learning_rows(docs)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as good; the model learns from the labels of the rows that came here."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_only(docs, quality.fit(docs, labels))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id."""
    ready(spark)
    return simhash.one_of_each(docs, words=4, seed=42, bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item."""
    ready(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end=1)[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Trained models, hashes and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
