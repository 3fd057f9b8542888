"""Queries for spelling variants, nearest vectors and the prefix trie of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywatch.llm import nearest, prefix_trie, variants
from tallywatch.llm.common import query, read


@query("op11_spelling_variants", variants.oracle_sql())
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(read(spark, sf_dir, "documents"))


@query("op12_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"))


@query("op13_prefix_trie", prefix_trie.oracle_sql())
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(read(spark, sf_dir, "conversations"))
