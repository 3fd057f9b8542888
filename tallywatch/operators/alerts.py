"""Alert rules, cooldowns, alert state and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywatch.functions.bands import meets
from tallywatch.functions.text import alert_message, seconds_between
from tallywatch.operators import summaries as S
from tallywatch.session import local_table

RULE_SCHEMA = (
    "rule_id string, name string, metric_name string, condition string, threshold double, severity string, "
    "alert_type string, cooldown_seconds double, model_ids array<string>"
)
# The rules every installation starts with.
DEFAULT_RULES = (
    ("performance_degradation_critical", "Critical Performance Degradation", "accuracy", "<", 0.7, "critical", "performance_degradation", 1800.0, None),
    ("data_drift_high", "High Data Drift Detected", "jsd_score", ">", 0.3, "high", "data_drift", 3600.0, None),
    ("bias_detection_critical", "Critical Bias Detected", "demographic_parity_difference", ">", 0.2, "critical", "bias_detection", 1800.0, None),
    ("data_quality_low", "Low Data Quality", "data_quality_score", "<", 0.6, "medium", "data_quality", 3600.0, None),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple] = DEFAULT_RULES) -> DataFrame:
    return local_table(spark, list(rules), RULE_SCHEMA)


def match_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric points (event_id, model_id, metric_name, metric_value, ts) that meet a rule, one row per rule met.

    A rule without models applies to all, and a point without a model meets every rule.
    """
    condition = F.col("r_condition")
    table = S.broadcast_if_small(rules.select(*[F.col(c).alias(c if c == "metric_name" else f"r_{c}") for c in rules.columns]))
    wanted = (
        F.col("r_model_ids").isNull()
        | (F.size("r_model_ids") == 0)
        | F.col("model_id").isNull()
        | F.array_contains("r_model_ids", F.col("model_id").cast("string"))
    )
    rows = metrics.join(table, "metric_name").where(F.coalesce(wanted, F.lit(True)))
    return rows.where(meets(F.col("metric_value"), condition, F.col("r_threshold")))


def _following(t, gap):
    """For each position the first position at least ``gap`` later (len(t) if none)."""
    import numpy as np

    return np.searchsorted(t, t + gap, side="left")


def _stretch_effect(frame):
    """How a stretch changes the time of the last firing, as a step function of the earliest allowed time."""
    import numpy as np
    import pandas as pd

    t = np.sort(frame["us"].to_numpy())
    gap, start = int(frame["gap"].iloc[0]), int(t[0])
    nxt = _following(t, gap)
    last = np.where(nxt < len(t), nxt, np.arange(len(t)))
    while True:  # follow the chain to its end, doubling the jump
        further = last[last]
        if (further == last).all():
            break
        last = further
    stop = min(np.searchsorted(t, start + gap, side="left"), len(t) - 1)
    first, end = t[: stop + 1], t[last[: stop + 1]]
    keep = np.append(end[1:] != end[:-1], True)
    return pd.DataFrame(
        {"rule_id": frame["rule_id"].iloc[0], "stretch": frame["stretch"].iloc[0], "upto": first[keep], "last": end[keep], "gap": gap}
    )


def _walk_stretches(frame):
    """Earliest allowed firing time on entry to each stretch of one rule."""
    import numpy as np
    import pandas as pd

    frame = frame.sort_values(["stretch", "upto"])
    gap = int(frame["gap"].iloc[0])
    allowed = None
    out = []
    for stretch, part in frame.groupby("stretch", sort=True):
        upto, last = part["upto"].to_numpy(), part["last"].to_numpy()
        out.append((part["rule_id"].iloc[0], stretch, allowed))
        at = 0 if allowed is None else int(np.searchsorted(upto, allowed, side="left"))
        if at < len(upto):
            allowed = int(last[at]) + gap
    return pd.DataFrame(out, columns=["rule_id", "stretch", "allowed"]).astype({"stretch": "int64", "allowed": "Int64"})


def _fire(frame):
    """Positions of one stretch that fire, given the earliest allowed time."""
    import numpy as np
    import pandas as pd

    frame = frame.sort_values("us")
    t, gap = frame["us"].to_numpy(), int(frame["gap"].iloc[0])
    allowed = frame["allowed"].iloc[0]
    at = 0 if pd.isna(allowed) else int(np.searchsorted(t, int(allowed), side="left"))
    fired = []
    while at < len(t):
        fired.append(at)
        at = int(np.searchsorted(t, t[at] + gap, side="left"))
    return frame.iloc[fired][["rule_id", "us"]]


def cooldown(matches: DataFrame, last_fired: DataFrame | None = None) -> DataFrame:
    """Matches that fire: a rule stays silent for its cooldown after each firing, over all models.

    ``last_fired`` (rule_id, last_us) carries state over from earlier data. Points of one instant
    collapse to the first by event_id. Points are cut into range parts of (rule, time), so a stretch of a rule
    holds no more than a part does, however long the cooldown. Each stretch is condensed to the
    effect it has on the last firing time, these few rows are walked per rule, and then every
    stretch decides for itself. A rule with most of the rows is thus spread over many tasks.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (F.col("r_cooldown_seconds") * 1_000_000).cast("bigint")
    rows = matches.withColumns({"rule_id": F.col("r_rule_id"), "us": us, "gap": gap})
    always = rows.where("gap <= 0")
    timed = rows.where("gap > 0")
    others = [c for c in rows.columns if c not in ("rule_id", "us", "gap", "event_id")]
    points = timed.groupBy("rule_id", "us", "gap").agg(F.min_by(F.struct("event_id", *others), "event_id").alias("_p"))
    if last_fired is not None:  # what the state still silences can't fire; nothing else depends on the state
        known = last_fired.select("rule_id", F.col("last_us").alias("known_last"))
        points = points.join(S.broadcast_if_small(known), "rule_id", "left").where("known_last IS NULL OR us >= known_last + gap").drop("known_last")
    slim = S.in_order(points.select("rule_id", "us", "gap"), "rule_id", "us")
    slim = slim.select("rule_id", "us", "gap", F.col("slot").cast("bigint").alias("stretch"))
    effects = slim.groupBy("rule_id", "stretch").applyInPandas(
        _stretch_effect, "rule_id string, stretch bigint, upto bigint, last bigint, gap bigint"
    )
    entry = effects.groupBy("rule_id").applyInPandas(_walk_stretches, "rule_id string, stretch bigint, allowed bigint")
    fired = slim.join(entry, ["rule_id", "stretch"]).groupBy("rule_id", "stretch").applyInPandas(_fire, "rule_id string, us bigint")
    kept = points.join(fired, ["rule_id", "us"]).select("rule_id", "us", "gap", "_p.*")
    return kept.unionByName(always.select(*kept.columns))


def alert_rows(fired: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return fired.select(
        *keep,
        F.concat_ws("-", "rule_id", F.col("event_id").cast("string")).alias("alert_id"),
        "rule_id",
        F.col("r_alert_type").alias("alert_type"),
        F.col("r_severity").alias("severity"),
        "model_id",
        "metric_name",
        "metric_value",
        F.col("r_threshold").alias("threshold"),
        F.lit("active").alias("status"),
        F.col("ts").alias("triggered_at"),
        alert_message(
            F.col("r_name"), F.col("metric_name"), F.col("metric_value"), F.col("r_condition"), F.col("r_threshold"), F.col("model_id")
        ).alias("message"),
    )


def evaluate_rules(metrics: DataFrame, rules: DataFrame, last_fired: DataFrame | None = None) -> DataFrame:
    """Alerts from metric points: match, condition, cooldown, message."""
    return alert_rows(cooldown(match_rules(metrics, rules), last_fired))


def lifecycle(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with status and times from a log (alert_id, action, ts).

    The first resolve counts; an acknowledge counts only before it.
    """
    at = lambda a: F.min(F.when(F.col("action") == a, F.col("ts")))
    log = actions.groupBy("alert_id").agg(at("acknowledge").alias("_a"), at("resolve").alias("resolved_at"))
    valid = F.when(F.col("resolved_at").isNull() | (F.col("_a") < F.col("resolved_at")), F.col("_a"))
    status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("active")
    return (
        alerts.drop("status")
        .join(log, "alert_id", "left")
        .withColumn("acknowledged_at", valid)
        .withColumn("status", status)
        .drop("_a")
    )


def invalid_actions(actions: DataFrame) -> DataFrame:
    """Actions that change nothing: acknowledging what is no longer active, resolving twice."""
    before = Window.partitionBy("alert_id").orderBy("ts", "action").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda a: F.coalesce(F.max(F.col("action") == a).over(before), F.lit(False))
    return actions.withColumns({"_r": seen("resolve"), "_a": seen("acknowledge")}).where(
        F.col("_r") | (F.col("_a") & (F.col("action") == "acknowledge"))
    ).drop("_r", "_a")


def alert_statistics(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """(kind, name, value): counts by severity and type, ten busiest rules, mean seconds to act, total.

    Both mean times are taken over acknowledged alerts.
    """
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    rows = alerts.where(F.col("triggered_at") >= since)
    cells = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), c.alias("name"))
            for k, c in (("severity", F.col("severity")), ("type", F.col("alert_type")), ("rule", F.col("rule_id")), ("total", F.lit("alerts")))
        ]
    )
    counts = rows.select(F.inline(cells)).groupBy("kind", "name").agg(F.count(F.lit(1)).cast("double").alias("value"))
    ranked = S.top_rows(counts.where("kind = 'rule'"), ["kind"], [F.col("value").desc(), F.col("name")], 10).drop("rank")
    acknowledged = F.col("acknowledged_at").isNotNull()
    times = rows.where(acknowledged).agg(
        F.coalesce(F.avg(seconds_between(F.col("acknowledged_at"), F.col("triggered_at"))), F.lit(0.0)).alias("acknowledge"),
        F.coalesce(F.avg(seconds_between(F.col("resolved_at"), F.col("triggered_at"))), F.lit(0.0)).alias("resolve"),
    )
    means = times.unpivot([], ["acknowledge", "resolve"], "name", "value").select(F.lit("mean_seconds").alias("kind"), "name", "value")
    return counts.where("kind <> 'rule'").unionByName(ranked).unionByName(means)


def throttle(alerts: DataFrame, keys: Sequence[str], max_per_hour: int) -> DataFrame:
    """The first ``max_per_hour`` alerts per key and clock hour."""
    hourly = alerts.withColumn("_hour", F.date_trunc("hour", F.col("triggered_at").cast("timestamp")))
    return S.top_rows(hourly, [*keys, "_hour"], [F.col("triggered_at"), F.col("alert_id")], max_per_hour).drop("_hour", "rank")


def trigger_points(series: DataFrame, threshold: float, changes_by: float, z_limit: float = 3.0, trailing: int = 20) -> DataFrame:
    """(model_id, metric, ts, value, trigger) for threshold, trend and anomaly triggers on a metric series."""
    order = Window.partitionBy("model_id", "metric").orderBy("ts")
    before = order.rowsBetween(-trailing, -1)
    rows = series.withColumns(
        {
            "_prev": F.lag("value").over(order),
            "_mean": F.avg("value").over(before),
            "_std": F.stddev_pop("value").over(before),
            "_n": F.count("value").over(before),
        }
    )
    z = F.try_divide(F.col("value") - F.col("_mean"), F.col("_std"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("value") > threshold, F.lit("threshold")),
            F.when(F.abs(F.col("value") - F.col("_prev")) > changes_by, F.lit("trend")),
            F.when((F.col("_n") >= 2) & (F.abs(z) > z_limit), F.lit("anomaly")),
        )
    )
    return rows.withColumn("trigger", F.explode(kinds)).select("model_id", "metric", "ts", "value", "trigger")


def context(rows: DataFrame, ts: str, model_id: Column | str | None, as_of: str, hours: int = 24) -> DataFrame:
    """Rows of one model in the hours before ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    start = end - F.make_dt_interval(hours=F.lit(hours))
    out = rows.where(F.col(ts).between(start, end))
    return out if model_id is None else out.where(F.col("model_id") == model_id)
