"""From documents to packed training windows: each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import decontaminate, linededup, packing, simhash, toxicity
from textloom.llm.common import clear, remove, shared_dir, spooled


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs; n_chars, where there is one, counts the present text."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model fitted to their labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels), toxic_only=False).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less repeated lines; one that had lines and lost all of them goes."""
    out = linededup.dedup(docs)
    return _as_documents(out.where("n_removed = 0 or text rlike '\\\\S'"), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less passages of the benchmark; one of which no word is left goes."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _as_documents(out.where("removed_words = 0 or removed_words < n_words"), docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per packed piece of a document."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-dedup", dedup_documents), ("decontamination", remove_benchmark), ("packing", pack_windows)]

#: A model fitted by gradients, perfect hashes, connected components and least squares have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written to the shared folder and read by the next. What a stage needed is removed once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = spooled()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        clear(spark, before)
        if k:
            remove(spark, f"{at}/{k - 1}")
    return docs
