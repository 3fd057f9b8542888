"""A corpus from raw documents to packed training windows.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last give back the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.llm import exact, minhash, packing, quality, secret_scan
from tallywatch.llm.common import read, stored


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` less the documents that ``found`` does not keep. A document without an id can't be named, and stays."""
    gone = found.where(~F.col("kept")).select("doc_id").where("doc_id IS NOT NULL").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id."""
    return _without(docs, exact.exact_duplicates(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, linked at a similarity of 0.8 of five-word shingles, the document with the smallest doc_id."""
    return _without(docs, minhash.near_duplicates(docs, percent=80, words=5))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their places in windows of 4096."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
