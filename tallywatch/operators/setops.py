"""Schemas and rows as sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.operators import summaries as S
from tallywatch.session import local_table, stored_size


def schema_diff(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """(column, presence, ref_type, cur_type, same_type) for every column of either table."""
    left, right = dict(ref.dtypes), dict(cur.dtypes)
    names = [*left, *[c for c in right if c not in left]]
    rows = []
    for name in names:
        where = "both" if name in left and name in right else "ref_only" if name in left else "cur_only"
        rows.append((name, where, left.get(name), right.get(name), left.get(name) == right.get(name)))
    return local_table(ref.sparkSession,
        rows, "column string, presence string, ref_type string, cur_type string, same_type boolean"
    )


def duplicate_count(df: DataFrame, total: int | None = None) -> DataFrame:
    """Rows, distinct rows and surplus copies; nulls are equal. A known number of rows may be given.

    Only 128 bits of hashes of every row move, combined before the shuffle. Whole rows move only where a hash
    came up more than once, and are counted in full there, so rows that merely share a hash stay apart.
    """
    if not df.columns:
        raise ValueError("a table without columns has no rows to compare")
    hashed = [F.xxhash64(*df.columns).alias("_h1"), F.xxhash64(F.lit("second"), *df.columns).alias("_h2")]
    counts = df.select(*hashed).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    repeated, known, size = stored_size(counts.where("_n > 1"), "repeated")
    total = df.select(F.lit(1)).count() if total is None else total
    copies = repeated.agg(F.sum("_n")).first()[0] or 0
    hashes = repeated.select("_h1", "_h2")
    hashes = F.broadcast(hashes) if known <= S.BROADCAST_ROWS and size <= S.BROADCAST_BYTES else hashes
    again = df.select("*", *hashed).join(hashes, ["_h1", "_h2"], "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows, single = F.lit(total).cast("long"), F.lit(total - copies).cast("long")
    return again.agg(F.count(F.lit(1)).alias("_distinct")).select(
        rows.alias("rows"), (single + F.col("_distinct")).alias("distinct_rows"), (rows - single - F.col("_distinct")).alias("duplicate_rows")
    )


def dedupe(df: DataFrame, subset: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per ``subset`` in ``order``."""
    first = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
