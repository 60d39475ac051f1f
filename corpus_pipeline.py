"""Corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below
``spark.checkpoint.dir`` and reads it again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.  Empty tables pass through every stage; null texts are kept until packing, where they
are an end id alone.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession

from ledgershield.llm.common import written
from ledgershield.llm.decontaminate import drop_contaminated
from ledgershield.llm.packing import pack_documents
from ledgershield.llm.pii import mask_personal_data
from ledgershield.llm.simhash import simhash_deduplicate
from ledgershield.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id."""
    return simhash_deduplicate(docs, shingle=4, max_bits=4)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; n_chars follows."""
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    # the workers also served other stages: let them remember fewer units
    return pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), capacity=2048, end_id=0, keep_units=300_000)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
          ("personal_data", personal_data), ("packing", packing)]

# Trained scores, XXH64 fingerprints and BPE ids are beyond SQL: tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
