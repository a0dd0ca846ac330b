"""The corpus pipeline: documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the
columns of documents (the last one: pieces). run() writes each stage's rows to the shared folder and
reads them back. The stages need models and filters that SQL can't express, so ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import stages
from quire.llm._shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.keep_languages),
    ("jaccard_join", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_benchmark_leaks),
    ("secret_scan", stages.redact_secrets),
    ("packing", stages.pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
