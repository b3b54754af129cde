"""Corpus pipeline: the stages that turn raw documents into packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spliceloom.llm.common import materialize
from spliceloom.llm.stages import STAGES

#: No SQL form: several stages have none. tests/llm compares the run with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each stage reads what the last one wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
