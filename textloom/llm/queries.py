"""The operators' queries over the whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import cotrain, decontaminate, knn, linededup, lm, packing, simhash, substrings, tokenids, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return cotrain.score(docs, cotrain.fit(docs, _table(spark, sf_dir, "labels"))).drop("text", "lang", "source")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encode(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return knn.knn_join(vectors, vectors.where("vec_id % 100 = 0")).withColumn("distance", F.round("distance", 6))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).drop("spans")


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {
    "op1_cotrain": op1_cotrain,
    "op2_decontaminate": op2_decontaminate,
    "op3_substrings": op3_substrings,
    "op4_linededup": op4_linededup,
    "op5_lm": op5_lm,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_tokenids": op8_tokenids,
    "op9_knn": op9_knn,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op4_linededup": linededup.ORACLE_SQL,
    "op9_knn": knn.ORACLE_SQL,
}
