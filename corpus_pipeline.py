"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; it is written as
Parquet and read again before the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenlake.llm import near_text, packing, quality, suffix_dedup, toxicity
from screenlake.llm.shared import Stages

STAGES = [
    ("quality", quality.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", near_text.stage),
    ("passages", suffix_dedup.stage),
    ("packing", packing.stage),
]

#: Isolation forest, ordinal regression and the suffix array cannot be put into SQL; a test has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn to ``documents``."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stages.save(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
