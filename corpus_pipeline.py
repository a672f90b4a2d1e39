"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. language: documents whose language cannot be told go.
2. near_dedup: one document of each group of near copies stays.
3. decontaminate: words of benchmark passages are cut out.
4. redact: secrets are replaced by a mark of their kind.
5. tokens: every text is encoded; one row of token counts and digests for each document.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from attest.llm import pipeline as P

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", P.language), ("near_dedup", P.near_dedup), ("decontaminate", P.decontaminate), ("redact", P.redact), ("tokens", P.tokens),
]
# Learnt weights and BPE merges are not SQL; tests/llm checks every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = P.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
