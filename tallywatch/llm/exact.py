"""Exact duplicates: combined locally, then in salted groups, then over all, always by full content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import stored, text_or_empty

#: White space that separates words, as a pattern.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, the text with every run of white space as one space (null: empty), and its SHA-256."""
    rows = docs.select(F.col("doc_id"), F.regexp_replace(text_or_empty(), SPACES, " ").alias("norm"))
    return rows.withColumn("text_sha256", F.sha2(F.encode("norm", "UTF-8"), 256))


def winners(docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row per distinct text: text_sha256, norm, keep_id, group_size.

    Grouping by digest, salt and the text itself combines equal rows within each input partition
    before anything moves; a large group then meets in ``salts`` places, and what is left of it, one
    row per salt, is combined by digest and text once more. Texts are compared in full at each step;
    a digest alone decides nothing.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    some = normalised(docs).groupBy("text_sha256", salt.alias("salt"), "norm").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    return some.groupBy("text_sha256", "norm").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row per document: keep_id (smallest doc_id of its text), group_size, kept, text_sha256.

    Null text counts as empty. Rows with a null doc_id belong to their group and count in its size, but
    a null is never the smallest and such a row is kept only where its whole group has no id. Rows
    repeated with the same doc_id all carry it, and are all kept if it is the smallest. An empty table gives an
    empty one; other columns are left out.
    """
    found = winners(docs, salts).groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    found = stored(found, "winners")
    # The texts were compared above: a digest that one text has stands for that text from here on.
    rows = normalised(docs)
    out = rows.select("doc_id", "text_sha256").join(found.where("texts = 1").drop("texts"), "text_sha256")
    shared = found.where("texts > 1").select("text_sha256")
    if not shared.isEmpty():  # two texts with one SHA-256: their rows are joined by text
        apart = rows.join(shared, "text_sha256", "left_semi")
        sizes = apart.groupBy("text_sha256", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(apart.join(sizes, ["text_sha256", "norm"]).drop("norm"))
    kept = F.when(F.col("keep_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
