"""Queries for secret scans, toxicity and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywatch.llm import quality, secret_scan, toxicity
from tallywatch.llm.common import query, read


@query("op1_secret_scan", secret_scan.oracle_sql())
def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query("op7_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))
