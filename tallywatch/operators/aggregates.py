"""Counts, moments, quantiles and named aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.bands import share
from tallywatch.operators import summaries as S
from tallywatch.session import local_table


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n, share) of non-null values."""
    long_df = S.long_categorical(df, columns, keep=())
    counts = long_df.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "feature").select("feature", "value", "n", (F.col("n") / F.col("_total")).alias("share"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max per numeric column, from two scans."""
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    looks, _ = S.first_look(df, list(columns or S.numeric_columns(df)), list(shares.values()))
    moments = local_table(
        df.sparkSession, [(r["feature"], r["n"], r["mean"], r["std"], r["min"], r["max"]) for r in looks],
        "feature string, count bigint, mean double, std double, min double, max double",
    )
    quartiles = S.quantiles_wide(S.condensed(df, looks, list(shares.values())), shares, weight="n").drop("n")
    return quartiles.join(F.broadcast(moments), "feature").select(*moments.columns, *shares)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column: exact in two steps, or a sketch on request."""
    long_df = S.long_categorical(df, columns, keep=())
    if approximate:
        return long_df.groupBy("feature").agg(F.approx_count_distinct("value").alias("distinct_values"))
    return long_df.distinct().groupBy("feature").agg(F.count("value").alias("distinct_values"))


def quantile(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    return S.exact_quantiles(S.long_numeric(df, [column], keep=()), shares)


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population deviation per column, 0 when there are no values."""
    wide = df.agg(*[F.coalesce(F.stddev_pop(S.clean(c)), F.lit(0.0)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "stddev_pop")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 when a side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0))


def correlation_importance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Absolute correlation of each feature with the target."""
    wide = df.agg(*[F.abs(correlation(S.clean(c), S.clean(target))).alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "importance")


def iqr_fences(long_df: DataFrame, factor: float = 1.5, weight: str | None = None) -> DataFrame:
    """(feature, q1, q3, iqr, low, high)."""
    q = S.quantiles_wide(long_df, {"q1": 0.25, "q3": 0.75}, weight=weight).withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.select(
        "feature",
        "q1",
        "q3",
        "iqr",
        (F.col("q1") - factor * F.col("iqr")).alias("low"),
        (F.col("q3") + factor * F.col("iqr")).alias("high"),
    )


def iqr_outliers(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cells strictly outside the fences: (key, feature, value, low, high)."""
    long_df = S.long_numeric(df, columns, keep=key)
    fences = iqr_fences(long_df.select("feature", "value"))
    return (
        long_df.join(F.broadcast(fences), "feature")
        .where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
        .select(*key, "feature", "value", "low", "high")
    )


def group_by(df: DataFrame, key: str) -> DataFrame:
    """Every row with its group's key as text and the group's size; groups stay spread out."""
    keyed = df.withColumn("group_key", F.coalesce(F.col(key).cast("string"), F.lit("undefined")))
    sizes = keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("group_size"))
    return keyed.join(sizes, "group_key")


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n, share of all rows in %)."""
    cells = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = cells.agg(F.sum("n").alias("t")).select("t").scalar()
    return cells.withColumn("percent", F.col("n") / total * 100.0)


AGGREGATIONS = ("sum", "average", "count", "min", "max", "median", "percentile", "rate", "ratio")


def metric_aggregation(
    metrics: DataFrame, keys: Sequence[str], value: str = "value", days: float = 1.0, percentile: float = 0.95,
    good: Column | None = None,
) -> DataFrame:
    """All named aggregations of a metric per key.

    ``rate`` is the count per day over ``days``, ``ratio`` the share of rows where ``good`` holds.
    Percentiles are exact and spread over slots; the rest is one aggregate.
    """
    good = good if good is not None else F.col(value) > 0
    plain = metrics.groupBy(*keys).agg(
        F.sum(value).alias("sum"),
        F.avg(value).alias("average"),
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.count(value) / F.lit(float(days))).alias("rate"),
        share(F.count_if(good), F.count(F.lit(1))).alias("ratio"),
    )
    long_df = metrics.where(F.col(value).isNotNull()).select(
        *keys, F.lit(value).alias("feature"), F.col(value).cast("double").alias("value")
    )
    ordered = S.quantiles_wide(long_df, {"median": 0.5, "percentile": percentile}, ["feature", *keys])
    return plain.join(ordered.drop("feature", "n"), list(keys), "left")


def catalog_summary(catalog: DataFrame, status: str, sums: Sequence[str] = (), means: Sequence[str] = ()) -> DataFrame:
    """Counts by status beside totals and means over the whole catalog, one row per status."""
    by_status = catalog.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    whole = catalog.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(c).alias(f"total_{c}") for c in sums],
        *[F.avg(c).alias(f"mean_{c}") for c in means],
    )
    one = F.lit(1)
    return by_status.withColumn("_k", one).join(whole.withColumn("_k", one), "_k").drop("_k")
