"""A training corpus in five stages, each on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybrook.llm import decontam, jaccard, langid, packing, quality
from tallybrook.llm.common import crc_mod, materialize, read

#: No SQL tells a stage's result: tests/llm hold them against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't find good go."""
    return quality.accept(docs, read(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: without letters, noise to the language that fits best, or with several
    languages that fit alike (a chance below 0.4)."""
    return langid.accept(docs, langid.fit(docs, train=crc_mod("doc_id", 4) != 2), score=0.4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (a Jaccard similarity of five-word shingles of at least 0.8) the one of the least doc_id stays.
    SimHash links come first; as fingerprints only estimate the similarity, a join of the sets finds the rest. Null texts
    count as empty and are copies of each other; rows with a null id stay where no row with an id is like them."""
    return jaccard.dedup(docs, shingle=5, least=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again as the next one's."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
