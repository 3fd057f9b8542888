"""Queries for near duplicates of documents and of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywatch.llm import embedding, minhash
from tallywatch.llm.common import query, read


@query("op2_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_embedding_dedup")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(read(spark, sf_dir, "embeddings"))
