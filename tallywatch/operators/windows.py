"""Computations over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.operators import summaries as S

# Metrics where a rise is bad.
ERROR_METRICS = ("mse", "mae", "rmse", "log_loss", "brier")


def rank_by(df: DataFrame, keys: Sequence[str], value: str, tie: str, absolute: bool = False) -> DataFrame:
    """1-based rank of each row within its key, largest (absolute) value first, missing values last.

    Rows are counted within range parts of (key, value, tie) and shifted by the sizes of the key's
    earlier parts, so a key, or one value of it, may hold most of the table.
    """
    size = S.clean(value)
    falling = F.col("_v").asc_nulls_last()
    rows = S.in_order(df.withColumn("_v", -(F.abs(size) if absolute else size)), *keys, falling, tie)
    sizes = rows.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("slot")) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(falling, tie))
    counted = rows.withColumn("_r", inside)
    ranked = S.null_safe_join(counted, sizes.select(*keys, "slot", before.alias("_before")), [*keys, "slot"], "left")
    return ranked.select(*df.columns, (F.col("_before") + F.col("_r")).cast("int").alias("rank"))


def latest_two(df: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str | None = None) -> DataFrame:
    """(keys, current, previous): the two newest values per key, by a bounded top-k.

    Of rows at one time the one with the larger ``tie`` (the value itself unless given) is the newer.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie or value).desc())
    rows = df.withColumn("_r", F.row_number().over(newest)).where("_r <= 2")
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(value))).alias("current"),
        F.max(F.when(F.col("_r") == 2, F.col(value))).alias("previous"),
    )


def trend_label(metric: Column, change: Column) -> Column:
    """improving / declining beyond 1%, the sign turned for error metrics."""
    gain = F.when(metric.isin(*ERROR_METRICS), -change).otherwise(change)
    return F.when(gain > 1, "improving").when(gain < -1, "declining").otherwise("stable")


def metric_trend(series: DataFrame) -> DataFrame:
    """Latest against previous value per model and metric: rows (model_id, metric, ts, value)."""
    two = latest_two(series, ["model_id", "metric"], "ts", "value").where("previous IS NOT NULL")
    change = F.try_divide(F.col("current") - F.col("previous"), F.col("previous")) * 100
    return two.withColumn("change_percentage", change).withColumn(
        "trend", trend_label(F.col("metric"), F.col("change_percentage"))
    )


def trailing_baseline(batches: DataFrame, threshold: float = 0.1, size: int = 5) -> DataFrame:
    """Each batch mean against the mean of the previous ``size`` batch means: (model_id, feature, ts, batch_mean)."""
    before = Window.partitionBy("model_id", "feature").orderBy("ts").rowsBetween(-size, -1)
    base = F.avg("batch_mean").over(before)
    return (
        batches.withColumn("baseline", base)
        .where("baseline IS NOT NULL")
        .withColumn("drift_score", F.abs(F.col("batch_mean") - F.col("baseline")) / (F.abs(F.col("baseline")) + 1e-8))
        .withColumn("drift_detected", F.col("drift_score") > threshold)
    )


def waterfall(attributions: DataFrame, key: str, base: str) -> DataFrame:
    """Running total from the base value, largest absolute attribution first, then the prediction row.

    Input (key, base, feature, attribution); a key has one row per feature.
    """
    order = [F.abs("attribution").desc(), F.col("feature")]
    w = Window.partitionBy(key).orderBy(*order)
    running = F.col(base) + F.sum("attribution").over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = attributions.select(
        key, F.row_number().over(w).alias("step"), "feature", "attribution", running.alias("cumulative")
    )
    first_last = attributions.groupBy(key).agg(
        F.max(base).alias("_base"), F.sum("attribution").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    ends = first_last.select(
        key,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("step"), F.lit("base").alias("feature"), F.col("_base").alias("attribution"), F.col("_base").alias("cumulative")),
                F.struct(
                    (F.col("_n") + 1).cast("int").alias("step"), F.lit("prediction").alias("feature"),
                    F.lit(0.0).alias("attribution"), (F.col("_base") + F.col("_sum")).alias("cumulative"),
                ),
            )
        ),
    )
    return steps.unionByName(ends)


def importance_change(history: DataFrame) -> DataFrame:
    """Latest against previous importance per feature: rows (model_id, feature, ts, importance)."""
    two = latest_two(history, ["model_id", "feature"], "ts", "importance").where("previous IS NOT NULL")
    delta = F.col("current") - F.col("previous")
    return two.withColumn("delta", delta).withColumns(
        {"stable": F.abs("delta") < 0.01, "changed": F.abs("delta") > 0.1}
    )


def sliding_request_count(df: DataFrame, key: str, ts: str, span: int = 60, limit: int = 100, chunk: int = 3600) -> DataFrame:
    """Requests by one key in the trailing ``span`` seconds: (key, second, requests, in_window, over_limit).

    Requests collapse to one row per key and second first. Time is cut into chunks so that
    a busy key is spread over tasks; each chunk also sees the last ``span`` seconds before it.
    """
    seconds = df.groupBy(F.col(key), F.unix_seconds(F.col(ts).cast("timestamp")).alias("second")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    own = F.floor(F.col("second") / chunk)
    following = F.floor((F.col("second") + span) / chunk)
    spread = seconds.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array(F.col("_own"), following)))
    )
    w = Window.partitionBy(key, "_chunk").orderBy("second").rangeBetween(-span, 0)
    return (
        spread.withColumn("in_window", F.sum("requests").over(w))
        .where(F.col("_chunk") == F.col("_own"))
        .select(key, "second", "requests", "in_window", (F.col("in_window") > limit).alias("over_limit"))
    )
