"""Model performance, monitoring rows and alerts on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.bands import share
from tallywatch.operators import summaries as S
from tallywatch.operators.windows import latest_two, metric_trend
from tallywatch.session import local_table, materialise

LOG_CLIP = 2.220446049250313e-16


def classification_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy and support-weighted precision, recall, F1 per key, from the class table only."""
    keys = list(keys)
    cells = df.groupBy(*keys, F.col(label).cast("string").alias("_y"), F.col(prediction).cast("string").alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_y").alias("cls"), F.col("_n").alias("support"), zero.alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("_p").alias("cls"), zero.alias("support"), F.col("_n").alias("predicted"), zero.alias("tp")),
    )
    classes = cells.select(*keys, F.inline(sides)).groupBy(*keys, "cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    precision, recall = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("support"))
    f1 = share(2.0 * F.col("tp"), F.col("predicted") + F.col("support"))

    def weighted(value: Column) -> Column:
        return share(F.sum(value * F.col("support")), F.sum("support"))

    return classes.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        share(F.sum("tp"), F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1_score"),
    )


def _r2(sse: Column, sst: Column) -> Column:
    return F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(sse, sst))


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = (), features: int = 1) -> DataFrame:
    """mse, rmse, mae, r2, adjusted r2 and mape (rows with label 0 left out) in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    gap = y - p
    n = F.count(F.lit(1))
    r2 = _r2(F.sum(gap * gap), F.var_pop(y) * n)
    return df.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(gap * gap).alias("mse"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        r2.alias("r2_score"),
        (1.0 - (1.0 - r2) * F.try_divide((n - 1).cast("double"), (n - F.lit(features) - 1).cast("double"))).alias("adjusted_r2"),
        (F.avg(F.try_divide(F.abs(gap), F.abs(y))) * 100).alias("mape"),
    )


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows with residual and standardised residual (population deviation of all residuals)."""
    rows = df.withColumn("residual", F.col(label).cast("double") - F.col(prediction).cast("double"))
    spread = rows.agg(F.stddev_pop("residual").alias("s")).select("s").scalar()
    return rows.withColumn("standardised", F.coalesce(F.try_divide(F.col("residual"), spread), F.lit(0.0)))


def roc_auc(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact AUC per key from rows (keys, score, label 0/1); ties share their rank; null with one class.

    Rank sums come from spread cumulative counts, so a group may be as large as the table.
    """
    keys = ["feature", *keys]
    # Written once: the limits, the slot totals and the running sums all read it.
    counts = materialise(
        scores.where("score IS NOT NULL AND label IS NOT NULL")
        .withColumns({"feature": F.lit("score"), "value": F.col("score").cast("double")})
        .groupBy(*keys, "value")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    running = S.cumulative(counts, ("pos", "neg"), S.slot_limits(counts), keys, few_keys=len(keys) == 1)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return running.groupBy(*keys).agg(
        F.max("total_pos").alias("positives"),
        F.max("total_neg").alias("negatives"),
        F.try_divide(wins, F.max("total_pos").cast("double") * F.max("total_neg")).alias("auc"),
    ).drop("feature")


def roc_auc_multiclass(scores: DataFrame) -> DataFrame:
    """One-vs-rest AUC averaged over classes: rows (cls, score, label) with one row per sample and class."""
    return roc_auc(scores, ["cls"]).agg(F.avg("auc").alias("auc"), F.count("auc").alias("classes"))


def auto_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(metric, value): classification metrics up to 10 distinct labels, regression metrics above."""
    few = df.select(label).where(F.col(label).isNotNull()).distinct().limit(11).count() <= 10
    if few:
        wide = classification_metrics(df, label, prediction).drop("n")
    else:
        wide = regression_metrics(df, label, prediction).select("mse", "rmse", "mae", "r2_score")
    return wide.unpivot([], wide.columns, "metric", "value")


def threshold_curve(scores: DataFrame, keys: Sequence[str] = (), parts: int = 100) -> DataFrame:
    """Points of the ROC and precision-recall curves at thresholds i / parts, from a score histogram."""
    bucket = F.least(F.greatest(F.floor(F.col("score") * parts), F.lit(0)), F.lit(parts)).cast("int")
    cells = scores.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n")
    )
    packed = cells.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("_p", "_n")))).alias("_m"),
        F.sum("_p").alias("_tp"),
        F.sum("_n").alias("_tn"),
    )
    grid = packed.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts)))).withColumn(
        "_c", F.try_element_at("_m", F.col("bucket"))
    )
    down = Window.partitionBy(*keys).orderBy(F.col("bucket").desc())
    tp = F.sum(F.coalesce(F.col("_c._p"), F.lit(0))).over(down)
    fp = F.sum(F.coalesce(F.col("_c._n"), F.lit(0))).over(down)
    return grid.withColumns({"tp": tp, "fp": fp}).select(
        *keys,
        (F.col("bucket") / parts).alias("threshold"),
        "tp",
        "fp",
        share(F.col("tp"), F.col("_tp")).alias("tpr"),
        share(F.col("fp"), F.col("_tn")).alias("fpr"),
        share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def performance_by_side(sided: DataFrame, label: str, prediction: str, task: str = "classification") -> DataFrame:
    """Degradation between the sides: values, changes and a label at +-0.05."""
    if task == "classification":
        rows, main, second = classification_metrics(sided, label, prediction, ["side"]), "accuracy", "f1_score"
        lead = main
    else:
        rows, main, second = regression_metrics(sided, label, prediction, ["side"]), "mse", "r2_score"
        lead = second

    def at(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    out = rows.agg(*[at(s, m).alias(f"{m}_{s}") for m in (main, second) for s in ("ref", "cur")])
    change = F.col(f"{lead}_cur") - F.col(f"{lead}_ref")
    return out.withColumns(
        {
            f"{main}_change": F.col(f"{main}_cur") - F.col(f"{main}_ref"),
            f"{second}_change": F.col(f"{second}_cur") - F.col(f"{second}_ref"),
            f"relative_{main}_change": F.when(
                F.col(f"{main}_ref") > 0, F.try_divide(F.col(f"{main}_cur") - F.col(f"{main}_ref"), F.col(f"{main}_ref"))
            ).otherwise(0.0),
            "interpretation": F.when(change < -0.05, "degraded").when(change > 0.05, "improved").otherwise("stable"),
        }
    )


def track_batches(predictions: DataFrame) -> DataFrame:
    """One monitoring row per model and batch from rows (model_id, batch, ts, prediction, label, revenue)."""
    good = F.when(F.col("label").isNotNull(), (F.col("label") == F.col("prediction")).cast("double"))
    return predictions.groupBy("model_id", "batch").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count("label").alias("labelled"),
        F.avg(F.col("prediction").cast("double")).alias("mean_prediction"),
        F.avg(good).alias("accuracy"),
        F.sum("revenue").alias("revenue"),
        F.max("ts").alias("last_ts"),
    )


# Default alert thresholds per metric, with the direction that is bad.
ALERT_THRESHOLDS = (
    ("accuracy", 0.8, "low"),
    ("f1_score", 0.75, "low"),
    ("r2_score", 0.7, "low"),
    ("mse", 1000.0, "high"),
)
DRIFT_THRESHOLD = 0.1


def threshold_alerts(metrics: DataFrame, thresholds: Sequence[tuple[str, float, str]] = ALERT_THRESHOLDS) -> DataFrame:
    """Alert rows for long metrics (model_id, ts, metric, value) beyond their threshold."""
    table = local_table(metrics.sparkSession, list(thresholds), "metric string, threshold double, bad string")
    hit = F.when(F.col("bad") == "low", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    far = F.abs(F.col("value") - F.col("threshold")) > F.col("threshold") * 0.1
    return (
        metrics.join(F.broadcast(table), "metric")
        .where(hit)
        .select("model_id", "ts", "metric", "value", "threshold", F.when(far, "high").otherwise("medium").alias("severity"))
    )


def business_impact(outcomes: DataFrame) -> DataFrame:
    """(model_id, metric, total, average, points, trend) of rows (model_id, metric, ts, value)."""
    sums = outcomes.groupBy("model_id", "metric").agg(
        F.sum("value").alias("total"), F.avg("value").alias("average"), F.count(F.lit(1)).alias("points")
    )
    two = latest_two(outcomes, ["model_id", "metric"], "ts", "value")
    rising = F.when(F.col("current") > F.col("previous"), "positive").otherwise("stable")
    return sums.join(two, ["model_id", "metric"]).select(
        "model_id", "metric", "total", "average", "points", rising.alias("trend")
    )


def health_summary(series: DataFrame, drift: DataFrame, alerts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per model: metric trends, total value, drift state, recent alerts, and what to do first."""
    trends = metric_trend(series).groupBy("model_id").agg(
        F.count_if(F.col("trend") == "improving").alias("improving"),
        F.count_if(F.col("trend") == "declining").alias("declining"),
    )
    value = series.groupBy("model_id").agg(F.sum("value").alias("business_value"), F.count(F.lit(1)).alias("data_points"))
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    recent = F.col("triggered_at") >= since
    alarms = alerts.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(recent).alias("recent_alerts"),
        F.count_if(recent & (F.col("severity") == "high")).alias("critical_alerts"),
    )
    first = (
        F.when(F.col("critical_alerts") > 0, "critical")
        .when(F.col("current_status") == "drift_detected", "warning")
        .when(F.col("business_value") < 0, "business")
        .otherwise("success")
    )
    return (
        value.join(trends, "model_id", "left")
        .join(drift, "model_id", "left")
        .join(alarms, "model_id", "left")
        .na.fill(0, ["improving", "declining", "total_alerts", "recent_alerts", "critical_alerts"])
        .withColumn("recommendation", first)
    )


def monitoring_stats(configs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Models monitored, enabled checks and open alerts in one row."""
    one = F.lit(1)
    checks = configs.agg(
        F.count(F.lit(1)).alias("models"),
        *[F.count_if(F.col(c)).alias(f"{c}_enabled") for c in ("drift_check", "performance_check", "quality_check")],
    ).withColumn("_k", one)
    open_alerts = alerts.agg(F.count_if(F.col("status").isin("active", "acknowledged")).alias("active_alerts"))
    return checks.join(open_alerts.withColumn("_k", one), "_k").drop("_k")
