"""Custom metrics, KPI status, dashboards and period summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.operators import summaries as S
from tallywatch.operators.aggregates import AGGREGATIONS, metric_aggregation
from tallywatch.operators.windows import latest_two, trend_label
from tallywatch.session import local_table

DEFINITION_SCHEMA = "metric_id string, metric_name string, aggregation string, warning double, critical double, direction string"
# The metrics every installation starts with; ``direction`` says which side is bad.
DEFAULT_DEFINITIONS = (
    ("model_accuracy", "accuracy", "average", 0.8, 0.7, "low"),
    ("prediction_latency", "prediction_time_ms", "average", 100.0, 500.0, "high"),
    ("bias_score", "demographic_parity_difference", "max", 0.1, 0.2, "high"),
    ("data_drift_score", "jensen_shannon_divergence", "average", 0.1, 0.3, "high"),
    ("predictions_per_day", "predictions", "rate", 1000.0, 100.0, "low"),
    ("compliance_score", "compliance_score", "average", 0.8, 0.6, "low"),
)


def definition_table(spark: SparkSession, definitions: Sequence[tuple] = DEFAULT_DEFINITIONS) -> DataFrame:
    return local_table(spark, list(definitions), DEFINITION_SCHEMA)


def threshold_status(value: Column, warning: Column, critical: Column, direction: Column) -> Column:
    low = F.when(value <= critical, "critical").when(value <= warning, "warning").otherwise("good")
    high = F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("good")
    return F.when(value.isNull(), F.lit("no_data")).when(direction == "high", high).otherwise(low)


def _pick(aggregation: Column) -> Column:
    out = F.lit(None).cast("double")
    for name in AGGREGATIONS:
        out = F.when(aggregation == name, F.col(name).cast("double")).otherwise(out)
    return out


def metric_values(series: DataFrame, definitions: DataFrame, days: float, model_level: bool = True) -> DataFrame:
    """Every defined metric per model (or over all models) from one grouped job.

    ``series`` is (model_id, metric_name, ts, value), already cut to the wanted range.
    """
    keys = ["model_id", "metric_name"] if model_level else ["metric_name"]
    table = S.broadcast_if_small(definitions)
    known = series.join(table.select("metric_name").distinct(), "metric_name", "left_semi")
    values = metric_aggregation(known, keys, days=days)
    rows = values.join(table, "metric_name").withColumn("metric_value", _pick(F.col("aggregation")))
    status = threshold_status(F.col("metric_value"), F.col("warning"), F.col("critical"), F.col("direction"))
    return rows.select("metric_id", *keys, "aggregation", "metric_value", status.alias("threshold_status"))


def kpi_vs_target(values: DataFrame, targets: DataFrame) -> DataFrame:
    """Values (kpi_id, value) against (kpi_id, target_value, tolerance_lower, tolerance_upper)."""
    ratio = F.try_divide(F.col("value"), F.col("target_value"))
    low, high = F.col("target_value") - F.col("tolerance_lower"), F.col("target_value") + F.col("tolerance_upper")
    band = F.when(F.col("value") < low, "below").when(F.col("value") > high, "above").otherwise("on_target")
    return values.join(targets, "kpi_id").select("kpi_id", "value", "target_value", ratio.alias("achievement"), band.alias("status"))


def dashboard(series: DataFrame, definitions: DataFrame, days: float) -> DataFrame:
    """Value, status and trend of every metric and model in one result."""
    values = metric_values(series, definitions, days)
    two = latest_two(series, ["model_id", "metric_name"], "ts", "value")
    change = F.try_divide(F.col("current") - F.col("previous"), F.col("previous")) * 100
    trends = two.select("model_id", "metric_name", "current", change.alias("change_percentage"))
    label = F.when(F.col("change_percentage").isNull(), "insufficient_data").otherwise(
        trend_label(F.col("metric_name"), F.col("change_percentage"))
    )
    return values.join(trends, ["model_id", "metric_name"], "left").withColumn("trend", label)


# Days a reporting period reaches back.
PERIOD_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90}


def period_summary(series: DataFrame, alerts: DataFrame, drift: DataFrame, as_of: str, periods: Sequence[str] = tuple(PERIOD_DAYS)) -> DataFrame:
    """One row per period: metric points and mean, models, alerts by severity, drift events.

    Each table is read once; a row counts for every period it falls in.
    """
    end = F.lit(as_of).cast("timestamp_ntz")

    def spread(df: DataFrame, ts: str) -> DataFrame:
        cells = [
            F.when((F.col(ts) <= end) & (F.col(ts) > end - F.make_dt_interval(days=F.lit(PERIOD_DAYS[p]))), F.lit(p)) for p in periods
        ]
        return df.withColumn("period", F.explode(F.array_compact(F.array(*cells))))

    values = spread(series, "ts").groupBy("period").agg(
        F.count(F.lit(1)).alias("points"), F.avg("value").alias("mean_value"), F.count_distinct("model_id").alias("models")
    )
    alarms = spread(alerts, "triggered_at").groupBy("period").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity").isin("high", "critical")).alias("serious_alerts")
    )
    drifts = spread(drift.where("drift_detected"), "ts").groupBy("period").agg(F.count(F.lit(1)).alias("drift_events"))
    return values.join(alarms, "period", "full").join(drifts, "period", "full").na.fill(0, ["points", "models", "alerts", "serious_alerts", "drift_events"])


def widget_query(
    source: DataFrame, metric: str | None = None, aggregation: str = "average", filters: dict | None = None,
    group_by: Sequence[str] = (), custom_query: str | None = None,
) -> DataFrame:
    """Equality filters and one aggregation, or a SQL text over ``{source}``."""
    rows = source
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name) == value)
    if custom_query is not None:
        return source.sparkSession.sql(custom_query, source=rows)
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {aggregation}")
    keyed = rows if group_by else rows.withColumn("_all", F.lit(1))
    out = metric_aggregation(keyed, list(group_by) or ["_all"], metric)
    return out.select(*group_by, F.col(aggregation).cast("double").alias("value"))


FORMULA_FUNCTIONS = {
    "avg", "sum", "count", "min", "max", "median", "stddev_pop", "stddev_samp", "count_if", "abs", "round", "coalesce", "nullif", "if",
}
FORMULA_WORDS = {"and", "or", "not", "case", "when", "then", "else", "end", "null", "true", "false", "is", "in", "between"}


def check_formula(formula: str, columns: Sequence[str]) -> list[str]:
    """Names in a formula that are neither allowed functions, SQL words nor columns; empty means valid."""
    if re.search(r"[;`\\]|--|/\*", formula):
        return ["forbidden characters"]
    bare = re.sub(r"'[^']*'", " ", formula)
    bad = []
    for name, call in re.findall(r"([A-Za-z_]\w*)\s*(\()?", bare):
        word = name.lower()
        if call and word not in FORMULA_FUNCTIONS | FORMULA_WORDS:
            bad.append(name)
        if not call and word not in FORMULA_WORDS and name not in columns:
            bad.append(name)
    return bad


def custom_metric(series: DataFrame, formula: str, keys: Sequence[str] = (), name: str = "value") -> DataFrame:
    """A metric given as a SQL aggregate over the columns of ``series``."""
    bad = check_formula(formula, series.columns)
    if bad:
        raise ValueError(f"not allowed in a formula: {', '.join(bad)}")
    return series.groupBy(*keys).agg(F.expr(formula).cast("double").alias(name))
