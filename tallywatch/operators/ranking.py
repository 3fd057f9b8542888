"""Sorted and cut results. Every order ends in a tie-break, so results repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.operators import summaries as S


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column, ties by value."""
    counts = S.long_categorical(df, columns, keep=()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return S.top_rows(counts, ["feature"], [F.col("n").desc(), F.col("value")], k)


def sort_by(df: DataFrame, column: str, tie: Sequence[str] = (), descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc(), *tie)


def top_groups(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k largest groups."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *keys).limit(k)


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_features(
    importances: DataFrame, method: str, hidden: Sequence[str] = (), sort: str = "importance", n: int = 10
) -> DataFrame:
    """Features of one method, without hidden ones, by absolute importance, name or category."""
    orders = {
        "importance": [F.abs("importance").desc(), F.col("feature")],
        "name": [F.col("feature")],
        "category": [F.col("category"), F.abs("importance").desc(), F.col("feature")],
    }
    rows = importances.where(F.col("method") == method)
    if hidden:
        rows = rows.where(~F.col("feature").isin(*hidden))
    return rows.orderBy(*orders[sort]).limit(n)


def top_interactions(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Strongest feature pairs by absolute strength."""
    return pairs.orderBy(F.abs("strength").desc(), "feature_i", "feature_j").limit(k)
