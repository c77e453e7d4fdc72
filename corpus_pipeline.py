"""A corpus pipeline: each stage takes the documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, neardup, pieces, toxicity
from tidemark.llm.common import staged

STAGES = [
    ("language_id", langid.language_stage),
    ("toxicity", toxicity.toxicity_stage),
    ("near_duplicates", neardup.near_duplicate_stage),
    ("mixing", mixing.mixing_stage),
    ("sentencepiece", pieces.pieces_stage),
]

ORACLE_SQL = None  # trained models, ProbMinHash and Viterbi have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
