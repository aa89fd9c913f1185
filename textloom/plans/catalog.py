"""Registered queries over the driver's tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import contracts, corpus, evaluation, messages  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.reason_counts(spark, sf_dir)
