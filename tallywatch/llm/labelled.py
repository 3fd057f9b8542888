"""Bounded training samples: labelled rows, their texts, and the folds that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import stored, text_or_empty

#: Most labelled rows that a model is fitted on: the bound of the sample.
SAMPLE = 12_000


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(divisor))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, divisor: int, left_out: int, rows: int = SAMPLE) -> DataFrame:
    """(fold, text, label) of at most ``rows`` texts of labelled documents that are not held out, picked by hashes.

    At most ``rows`` doc_ids are picked. Rows with equal doc_id and text count once; where doc_ids have so many
    different texts that more than ``rows`` are left, ``rows`` pairs of doc_id and text are picked.

    Fold 0 to 3 comes from another hash. A document labelled more than once has its largest label;
    null labels are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(divisor) != left_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # Both samples have ``rows`` pairs of numbers at most; texts stay where they are.
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").distinct()
    found = stored(found.withColumn("hash", F.xxhash64("text")), "training_texts")
    picked = found.select("doc_id", "hash").distinct().orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash").limit(rows)
    found = found.join(F.broadcast(picked), ["doc_id", "hash"])
    return found.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).cast("int").alias("fold"), "text", "label")
