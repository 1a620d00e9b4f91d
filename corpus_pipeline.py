"""The corpus pipeline: quality rules, toxicity, SimHash near-duplicates, PII surrogates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import stages

STAGES = [
    ("quality rules", stages.quality),
    ("toxicity", stages.toxic),
    ("near-duplicates", stages.near_duplicates),
    ("pii", stages.pii),
    ("packing", stages.packing),
]

#: SQL can't express the learned, hashed and optimised stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir, STAGES)
