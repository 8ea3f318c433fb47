"""Corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes the documents that the one before it left and gives documents
with the same columns; the last gives packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentiforge.llm import disclosure, ngram_join, packing, passages, quality_rules
from sentiforge.llm.shared import written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_join", ngram_join.stage_rows),
    ("substring_dedup", passages.stage),
    ("pii", disclosure.stage),
    ("best_fit_packing", packing.stage),
]

# hashed models, signatures, chains and a tokenizer have no SQL form; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
