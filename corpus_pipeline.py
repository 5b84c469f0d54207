"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glucoflow.llm import stages
from glucoflow.llm.common import importable, materialize

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.language),
    ("line_dedup", stages.lines),
    ("minhash_near_dedup", stages.near),
    ("benchmark_decontamination", stages.benchmark),
    ("best_fit_packing", stages.pack),
]

#: no stage can be put in SQL; tests/llm holds the run against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
