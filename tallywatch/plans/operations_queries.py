"""Alert, audit, KPI, root-cause and stream queries on events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallywatch.operators import alerts as A
from tallywatch.operators import audit, filters, kpi, rca, windows
from tallywatch.plans.bindings import CATEGORICAL, NUMERIC, SIDED_SQL, query, read, rounded, sided_lineitem
from tallywatch.plans.drift_queries import CAT_SQL, DECILE_SQL, HIST_SQL, JS_EXPR, SHARES_SQL, drift_history
from tallywatch.plans.quality_queries import DEGRADED_SQL
from tallywatch.plans.table_queries import SERIES_SQL, daily_series
from tallywatch.session import local_table, materialise, shared_folder
from tallywatch.streaming import streams

# ------------------------------------------------------------------ alerts

RULES = (
    ("r_click", "Click value", "click", ">", 60.0, "high", "performance_degradation", 7200.0, None),
    ("r_view", "View value", "view", "<=", 20.0, "medium", "data_drift", 43200.0, ["1", "2"]),
    ("r_error", "Error value", "error", ">=", 90.0, "critical", "data_quality", 0.0, []),
    ("r_buy", "Purchase value", "purchase", "!=", 5.0, "low", "bias_detection", 259200.0, None),
)
RULES_SQL = """rules AS (SELECT * FROM (VALUES ('r_click', 'Click value', 'click', '>', 60.0::DOUBLE, 'high', 'performance_degradation', 7200), ('r_view', 'View value', 'view', '<=', 20.0, 'medium', 'data_drift', 43200),
   ('r_error', 'Error value', 'error', '>=', 90.0, 'critical', 'data_quality', 0), ('r_buy', 'Purchase value', 'purchase', '!=', 5.0, 'low', 'bias_detection', 259200)) t(rule_id, name, metric_name, condition, threshold, severity, alert_type, cool)),
mt AS (SELECT e.event_id, user_id % 5 AS model_id, event_type AS metric_name, value AS metric_value, ts, r.* EXCLUDE (metric_name) FROM events e JOIN rules r ON e.event_type = r.metric_name
   WHERE (rule_id <> 'r_view' OR user_id % 5 IN (1, 2)) AND CASE condition WHEN '>' THEN value > threshold WHEN '<=' THEN value <= threshold WHEN '>=' THEN value >= threshold ELSE abs(value - threshold) >= 1e-9 END)"""
FIRE_SQL = RULES_SQL + """, fire AS (SELECT rule_id, min(ts) AS ts FROM mt WHERE cool > 0 GROUP BY rule_id
   UNION ALL SELECT f.rule_id, min(m.ts) FROM fire f JOIN mt m ON m.rule_id = f.rule_id AND m.ts >= f.ts + to_seconds(m.cool) GROUP BY f.rule_id),
fired AS (SELECT mt.* FROM mt WHERE cool = 0
   UNION ALL (SELECT DISTINCT ON (mt.rule_id, mt.ts) mt.* FROM mt SEMI JOIN fire f ON mt.rule_id = f.rule_id AND mt.ts = f.ts ORDER BY mt.rule_id, mt.ts, mt.event_id))"""


def metric_points(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 5).alias("model_id"), F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), "ts"
    )


@query("joi_match_rules", f"WITH {RULES_SQL} SELECT event_id, rule_id FROM mt")
def _match(spark, sf_dir):
    return A.match_rules(metric_points(spark, sf_dir), A.rule_table(spark, RULES)).select("event_id", F.col("r_rule_id").alias("rule_id"))


def alerts(spark, sf_dir):
    return A.evaluate_rules(metric_points(spark, sf_dir), A.rule_table(spark, RULES))


EVALUATE_SQL = f"""WITH RECURSIVE {FIRE_SQL} SELECT rule_id || '-' || event_id AS alert_id, rule_id, alert_type, severity, model_id, metric_name, metric_value, threshold, 'active' AS status, ts AS triggered_at,
   name || ': ' || metric_name || ' = ' || printf('%.4f', metric_value) || ' ' || condition || ' ' || threshold || ' for model ' || model_id AS message FROM fired"""


@query("alr_evaluate_rules", EVALUATE_SQL)
def _evaluate(spark, sf_dir):
    return alerts(spark, sf_dir)


def alert_log(spark, sf_dir):
    """Every event above 60 as an alert, with acknowledge and resolve actions at fixed delays."""
    rows = read(spark, sf_dir, "events").where("value > 60").select(
        F.col("event_id").alias("alert_id"),
        F.col("event_type").alias("rule_id"),
        F.when(F.col("user_id") % 2 == 0, "data_drift").otherwise("data_quality").alias("alert_type"),
        F.when(F.col("value") > 150, "critical").when(F.col("value") > 100, "high").otherwise("medium").alias("severity"),
        (F.col("user_id") % 5).alias("model_id"),
        F.col("ts").alias("triggered_at"),
    )
    k = F.col("alert_id")
    at = lambda name, when, minutes: rows.where(when).select(
        "alert_id", F.lit(name).alias("action"), (F.col("triggered_at") + F.make_dt_interval(mins=F.lit(minutes))).alias("ts")
    )
    actions = at("acknowledge", k % 2 == 0, 10).unionByName(at("resolve", k % 3 == 0, 30)).unionByName(at("acknowledge", k % 9 == 0, 45))
    return rows, actions.unionByName(at("resolve", k % 21 == 0, 60))


LOG_SQL = """al AS (SELECT event_id AS alert_id, event_type AS rule_id, CASE WHEN user_id % 2 = 0 THEN 'data_drift' ELSE 'data_quality' END AS alert_type,
   CASE WHEN value > 150 THEN 'critical' WHEN value > 100 THEN 'high' ELSE 'medium' END AS severity, user_id % 5 AS model_id, ts AS triggered_at FROM events WHERE value > 60),
lc AS (SELECT *, CASE WHEN alert_id % 2 = 0 THEN triggered_at + INTERVAL 10 MINUTE END AS acknowledged_at, CASE WHEN alert_id % 3 = 0 THEN triggered_at + INTERVAL 30 MINUTE END AS resolved_at,
   CASE WHEN alert_id % 3 = 0 THEN 'resolved' WHEN alert_id % 2 = 0 THEN 'acknowledged' ELSE 'active' END AS status FROM al)"""


def tracked_alerts(spark, sf_dir):
    return A.lifecycle(*alert_log(spark, sf_dir))


@query("alr_lifecycle", f"WITH {LOG_SQL} SELECT alert_id, status, acknowledged_at, resolved_at FROM lc")
def _lifecycle(spark, sf_dir):
    return tracked_alerts(spark, sf_dir).select("alert_id", "status", "acknowledged_at", "resolved_at")


@query("alr_invalid_actions", f"""WITH {LOG_SQL} SELECT alert_id, 'acknowledge' AS action FROM al WHERE alert_id % 9 = 0 UNION ALL SELECT alert_id, 'resolve' FROM al WHERE alert_id % 21 = 0""")
def _invalid(spark, sf_dir):
    return A.invalid_actions(alert_log(spark, sf_dir)[1]).select("alert_id", "action")


@query("alr_statistics", f"""WITH {LOG_SQL}, r AS (SELECT * FROM lc WHERE triggered_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR)
   SELECT 'severity' AS kind, severity AS name, count(*)::DOUBLE AS value FROM r GROUP BY severity UNION ALL SELECT 'type', alert_type, count(*) FROM r GROUP BY alert_type
   UNION ALL SELECT * FROM (SELECT 'rule', rule_id, count(*) FROM r GROUP BY rule_id ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT 'total', 'alerts', count(*) FROM r
   UNION ALL SELECT 'mean_seconds', 'acknowledge', 600.0 UNION ALL SELECT 'mean_seconds', 'resolve', 1800.0""")
def _statistics(spark, sf_dir):
    return rounded(A.alert_statistics(tracked_alerts(spark, sf_dir), "2024-01-31", 240))


@query("alr_throttle", f"""WITH {LOG_SQL} SELECT alert_id FROM (SELECT alert_id, row_number() OVER (PARTITION BY rule_id, date_trunc('hour', triggered_at) ORDER BY triggered_at, alert_id) AS rn FROM al) WHERE rn <= 1""")
def _throttle(spark, sf_dir):
    return A.throttle(alert_log(spark, sf_dir)[0], ["rule_id"], 1).select("alert_id")


@query("alr_triggers", f"""WITH {SERIES_SQL}, w AS (SELECT *, lag(value) OVER o AS pv, avg(value) OVER b AS m, stddev_pop(value) OVER b AS s, count(value) OVER b AS n FROM series
   WINDOW o AS (PARTITION BY model_id, metric ORDER BY ts), b AS (PARTITION BY model_id, metric ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
   SELECT model_id, metric, ts, round(value, 6) AS value, 'threshold' AS "trigger" FROM w WHERE value > 55 UNION ALL SELECT model_id, metric, ts, round(value, 6), 'trend' FROM w WHERE abs(value - pv) > 15
   UNION ALL SELECT model_id, metric, ts, round(value, 6), 'anomaly' FROM w WHERE n >= 2 AND s > 0 AND abs((value - m) / s) > 2""")
def _triggers(spark, sf_dir):
    return rounded(A.trigger_points(daily_series(spark, sf_dir), 55, 15, 2.0))


@query("fil_active_alerts", f"WITH {LOG_SQL} SELECT alert_id, status FROM lc WHERE status IN ('active', 'acknowledged') AND severity IN ('critical', 'high') ORDER BY triggered_at DESC, alert_id LIMIT 25")
def _active(spark, sf_dir):
    return filters.active_alerts(tracked_alerts(spark, sf_dir), severities=["critical", "high"], limit=25).select("alert_id", "status")


@query("fil_model_alerts", f"WITH {LOG_SQL} SELECT alert_id, severity FROM lc WHERE model_id = 3 AND severity = 'high' ORDER BY triggered_at DESC, alert_id LIMIT 50")
def _model_alerts(spark, sf_dir):
    return filters.model_alerts(tracked_alerts(spark, sf_dir), 3, ["high"], 50).select("alert_id", "severity")


@query("top_triggered_rules", "SELECT event_type AS rule_id, count(*) AS n FROM events WHERE value > 60 GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 10")
def _top_rules(spark, sf_dir):
    from tallywatch.operators.ranking import top_groups

    return top_groups(alert_log(spark, sf_dir)[0], ["rule_id"], 10)


# ------------------------------------------------------------------ audit

AUDIT_SQL = """audit AS (SELECT event_id, ts, user_id::VARCHAR AS user_id, CASE event_type WHEN 'click' THEN 'data_accessed' WHEN 'purchase' THEN 'data_exported' WHEN 'error' THEN 'alert_triggered' WHEN 'signup' THEN 'user_created' ELSE 'user_login' END AS event_type,
   CASE WHEN value > 150 THEN 'critical' WHEN value > 80 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN user_id % 2 = 0 THEN 'dataset' ELSE 'model' END AS resource_type,
   'res' || (user_id % 7) AS resource_id, '10.0.0.' || (user_id % 40) AS ip_address FROM events)"""
CLASSIFIED_SQL = AUDIT_SQL + """, cl AS (SELECT *, event_type IN ('data_exported', 'data_accessed', 'user_created') AS compliance_relevant,
   greatest(CASE event_type WHEN 'data_accessed' THEN 6 WHEN 'data_exported' THEN 10 WHEN 'alert_triggered' THEN 3 WHEN 'user_created' THEN 10 ELSE 7 END, 7) AS retention_years FROM audit)"""


def audit_log(spark, sf_dir):
    t = F.col("event_type")
    kind = (
        F.when(t == "click", "data_accessed").when(t == "purchase", "data_exported").when(t == "error", "alert_triggered").when(t == "signup", "user_created").otherwise("user_login")
    )
    v, u = F.col("value"), F.col("user_id")
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", u.cast("string").alias("user_id"), kind.alias("event_type"),
        F.when(v > 150, "critical").when(v > 80, "high").when(v > 30, "medium").otherwise("low").alias("risk_level"),
        F.when(u % 2 == 0, "dataset").otherwise("model").alias("resource_type"),
        F.concat(F.lit("res"), u % 7).alias("resource_id"), F.concat(F.lit("10.0.0."), u % 40).alias("ip_address"),
    )


def classified(spark, sf_dir):
    return audit.classify_events(audit_log(spark, sf_dir), ["gdpr", "soc2"])


@query("fil_audit_trail", f"""WITH {AUDIT_SQL}, f AS (SELECT * FROM audit WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND event_type IN ('data_accessed', 'user_login') AND resource_type = 'dataset' AND risk_level IN ('high', 'critical'))
   SELECT event_id, event_type, (SELECT count(*) FROM f) AS total_count, 30 < (SELECT count(*) FROM f) AS has_more FROM f ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10""")
def _trail(spark, sf_dir):
    rows = filters.audit_trail(
        audit_log(spark, sf_dir), "2024-01-05", "2024-01-25", event_types=["data_accessed", "user_login"], resource_type="dataset", risk_levels=["high", "critical"]
    )
    return filters.trail_page(rows, 20, 10).select("event_id", "event_type", "total_count", "has_more")


@query("aud_classify_events", f"WITH {CLASSIFIED_SQL} SELECT event_id, compliance_relevant, retention_years::INTEGER AS retention_years, ts + to_days((365 * retention_years)::INTEGER) AS retention_until FROM cl")
def _classify(spark, sf_dir):
    return classified(spark, sf_dir).select("event_id", "compliance_relevant", "retention_years", "retention_until")


@query("aud_statistics", f"""WITH {CLASSIFIED_SQL} SELECT 'total' AS kind, 'events' AS name, count(*) AS value FROM cl UNION ALL SELECT 'type', event_type, count(*) FROM cl GROUP BY event_type UNION ALL SELECT 'risk', risk_level, count(*) FROM cl GROUP BY risk_level
   UNION ALL SELECT 'relevant', 'events', count(*) FROM cl WHERE compliance_relevant UNION ALL SELECT 'users', 'distinct', count(DISTINCT user_id) FROM cl""")
def _audit_statistics(spark, sf_dir):
    return audit.audit_statistics(classified(spark, sf_dir))


@query("aud_security_events", f"WITH {AUDIT_SQL} SELECT event_id, event_type, risk_level FROM audit WHERE risk_level IN ('high', 'critical') OR event_type LIKE '%login%' OR event_type LIKE '%role%' ORDER BY ts DESC, event_id LIMIT 100")
def _security(spark, sf_dir):
    return audit.security_events(audit_log(spark, sf_dir), 100).select("event_id", "event_type", "risk_level")


@query("aud_events_by_hour", "SELECT hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1")
def _by_hour(spark, sf_dir):
    return audit.events_by_hour(audit_log(spark, sf_dir))


@query("aud_top_addresses", f"WITH {AUDIT_SQL} SELECT ip_address, count(*) AS n FROM audit GROUP BY 1 ORDER BY n DESC, ip_address LIMIT 20")
def _addresses(spark, sf_dir):
    return audit.top_addresses(audit_log(spark, sf_dir))


@query("aud_processing_activities", f"""WITH {AUDIT_SQL} SELECT event_type, resource_type, resource_id, count(*) AS n, min(ts) AS first_occurrence, max(ts) AS last_occurrence FROM audit
   WHERE event_type IN ('data_uploaded', 'data_accessed', 'data_exported', 'data_deleted') AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' GROUP BY ALL""")
def _activities(spark, sf_dir):
    return audit.processing_activities(audit.in_period(audit_log(spark, sf_dir), "2024-01-03", "2024-01-28"))


@query("aud_breach_incidents", f"WITH {AUDIT_SQL} SELECT event_id, event_type FROM audit WHERE risk_level IN ('high', 'critical') AND event_type LIKE '%exported%'")
def _breaches(spark, sf_dir):
    return audit.breach_incidents(audit_log(spark, sf_dir), "%exported%").select("event_id", "event_type")


@query("aud_retention_expired", f"WITH {CLASSIFIED_SQL} SELECT event_id FROM cl WHERE ts + to_days((365 * retention_years)::INTEGER) < TIMESTAMP '2031-01-10'")
def _expired(spark, sf_dir):
    return audit.retention_expired(classified(spark, sf_dir), "2031-01-10").select("event_id")


# ------------------------------------------------------------------ KPIs

DEFS = (
    ("clicks_mean", "click", "average", 52.0, 45.0, "low"),
    ("errors_p95", "error", "percentile", 120.0, 170.0, "high"),
    ("views_rate", "view", "rate", 20.0, 5.0, "low"),
    ("purchases_total", "purchase", "sum", 1e6, 1e7, "high"),
    ("signup_median", "signup", "median", 40.0, 30.0, "low"),
)
DEFS_SQL = """defs AS (SELECT * FROM (VALUES ('clicks_mean', 'click', 'average', 52.0::DOUBLE, 45.0::DOUBLE, 'low'), ('errors_p95', 'error', 'percentile', 120.0, 170.0, 'high'), ('views_rate', 'view', 'rate', 20.0, 5.0, 'low'),
   ('purchases_total', 'purchase', 'sum', 1e6, 1e7, 'high'), ('signup_median', 'signup', 'median', 40.0, 30.0, 'low')) t(metric_id, metric_name, aggregation, warning, critical, direction)),
ser AS (SELECT user_id % 5 AS model_id, event_type AS metric_name, ts, value FROM events),
agg AS (SELECT model_id, metric_name, avg(value) AS a, quantile_cont(value, 0.95) AS p, count(*) / 30.0::DOUBLE AS r, sum(value) AS s, quantile_cont(value, 0.5) AS m FROM ser GROUP BY ALL),
kv AS (SELECT metric_id, model_id, metric_name, aggregation, CASE aggregation WHEN 'average' THEN a WHEN 'percentile' THEN p WHEN 'rate' THEN r WHEN 'sum' THEN s ELSE m END AS metric_value, warning, critical, direction FROM agg JOIN defs USING (metric_name)),
ks AS (SELECT *, CASE WHEN direction = 'high' THEN CASE WHEN metric_value >= critical THEN 'critical' WHEN metric_value >= warning THEN 'warning' ELSE 'good' END
   ELSE CASE WHEN metric_value <= critical THEN 'critical' WHEN metric_value <= warning THEN 'warning' ELSE 'good' END END AS threshold_status FROM kv)"""


def series(spark, sf_dir):
    return read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("model_id"), F.col("event_type").alias("metric_name"), "ts", "value")


@query("kpi_metric_values", f"WITH {DEFS_SQL} SELECT metric_id, model_id, metric_name, aggregation, round(metric_value, 4) AS metric_value, threshold_status FROM ks")
def _metric_values(spark, sf_dir):
    return rounded(kpi.metric_values(series(spark, sf_dir), kpi.definition_table(spark, DEFS), 30.0), 4)


@query("kpi_threshold_status", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'warning' ELSE 'good' END
   ELSE CASE WHEN value <= 20 THEN 'critical' WHEN value <= 40 THEN 'warning' ELSE 'good' END END AS status FROM events""")
def _threshold_status(spark, sf_dir):
    even = F.col("user_id") % 2 == 0
    status = kpi.threshold_status(
        F.col("value"), F.when(even, 50.0).otherwise(40.0), F.when(even, 100.0).otherwise(20.0), F.when(even, "high").otherwise("low")
    )
    return read(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("kpi_vs_target", """WITH v AS (SELECT event_type AS kpi_id, avg(value) AS value FROM events GROUP BY 1) SELECT kpi_id, round(value, 6) AS value, 50.0::DOUBLE AS target_value, round(value / 50, 6) AS achievement,
   CASE WHEN value < 49 THEN 'below' WHEN value > 50.5 THEN 'above' ELSE 'on_target' END AS status FROM v""")
def _target(spark, sf_dir):
    values = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kpi_id")).agg(F.avg("value").alias("value"))
    targets = values.select("kpi_id", F.lit(50.0).alias("target_value"), F.lit(1.0).alias("tolerance_lower"), F.lit(0.5).alias("tolerance_upper"))
    return rounded(kpi.kpi_vs_target(values, targets))


@query("kpi_dashboard", f"""WITH {DEFS_SQL}, rn AS (SELECT *, row_number() OVER (PARTITION BY model_id, metric_name ORDER BY ts DESC) AS rn FROM ser),
   tw AS (SELECT model_id, metric_name, max(value) FILTER (rn = 1) AS c, max(value) FILTER (rn = 2) AS p FROM rn GROUP BY ALL), tr AS (SELECT model_id, metric_name, c, (c - p) / p * 100 AS ch FROM tw)
   SELECT metric_id, model_id, metric_name, aggregation, round(metric_value, 4) AS metric_value, threshold_status, round(c, 4) AS current, round(ch, 4) AS change_percentage,
   CASE WHEN ch IS NULL THEN 'insufficient_data' WHEN ch > 1 THEN 'improving' WHEN ch < -1 THEN 'declining' ELSE 'stable' END AS trend FROM ks LEFT JOIN tr USING (model_id, metric_name)""")
def _kpi_dashboard(spark, sf_dir):
    return rounded(kpi.dashboard(series(spark, sf_dir), kpi.definition_table(spark, DEFS), 30.0), 4)


PERIOD = """pr AS (SELECT * FROM (VALUES ('daily', 1), ('weekly', 7), ('monthly', 30), ('quarterly', 90)) t(period, days)),
   dh AS (SELECT user_id % 5 AS model_id, CAST(ts AS DATE) AS d, avg(value) AS m FROM events GROUP BY ALL), dr AS (SELECT d FROM dh WHERE abs(m - 50) / 50 > 0.1)"""


@query("kpi_period_summary", f"""WITH {PERIOD}, e AS (SELECT period, count(*) AS points, avg(value) AS mean_value, count(DISTINCT user_id % 5) AS models, count(*) FILTER (value > 60) AS alerts, count(*) FILTER (value > 100) AS serious_alerts
     FROM events, pr WHERE ts <= TIMESTAMP '2024-01-30' AND ts > TIMESTAMP '2024-01-30' - to_days(days) GROUP BY period),
   f AS (SELECT period, count(*) AS drift_events FROM dr, pr WHERE d <= TIMESTAMP '2024-01-30' AND d > TIMESTAMP '2024-01-30' - to_days(days) GROUP BY period)
   SELECT period, points, round(mean_value, 6) AS mean_value, models, alerts, serious_alerts, coalesce(drift_events, 0) AS drift_events FROM e LEFT JOIN f USING (period)""")
def _period(spark, sf_dir):
    return rounded(kpi.period_summary(series(spark, sf_dir), alert_log(spark, sf_dir)[0], drift_history(spark, sf_dir), "2024-01-30"))


@query("kpi_widget_query", "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS value FROM events WHERE event_type = 'click' GROUP BY user_id")
def _widget(spark, sf_dir):
    return rounded(kpi.widget_query(read(spark, sf_dir, "events"), "value", "median", {"event_type": "click"}, ["user_id"]))


@query("kpi_widget_custom_query", "SELECT hour(ts)::INTEGER AS hour, max(value) AS peak FROM events WHERE event_type = 'view' GROUP BY 1")
def _widget_custom(spark, sf_dir):
    return kpi.widget_query(
        read(spark, sf_dir, "events"), filters={"event_type": "view"}, custom_query="SELECT hour(ts) AS hour, max(value) AS peak FROM {source} GROUP BY hour(ts)"
    )


@query("udf_custom_metric", "SELECT event_type, round(sum(value) / nullif(count(event_id), 0), 6) AS value FROM events GROUP BY event_type")
def _custom(spark, sf_dir):
    return rounded(kpi.custom_metric(read(spark, sf_dir, "events"), "sum(value) / nullif(count(event_id), 0)", ["event_type"]))


# ------------------------------------------------------------------ root cause

STRONG_SQL = SIDED_SQL.replace("l_extendedprice * 1.1::DOUBLE", "(l_extendedprice * 1.1::DOUBLE) * 1.5 / 1.1")
DRIFTED_SQL = f"""WITH {STRONG_SQL}, {HIST_SQL}, {CAT_SQL}, {SHARES_SQL}, {DECILE_SQL}, jsd AS (SELECT feature, {JS_EXPR} AS v FROM sh GROUP BY feature),
   df AS (SELECT feature FROM jsd WHERE v > 0.1 UNION SELECT feature FROM psi WHERE statistic > 0.1)"""


@query("rca_drift_hypothesis", DRIFTED_SQL + " SELECT 'perf_001' AS hypothesis_id, 'data_drift' AS category, 'high' AS severity, count(*) AS findings, least(1.0, count(*) * 0.2)::DOUBLE AS confidence FROM df HAVING count(*) > 0")
def _drift_hypothesis(spark, sf_dir):
    sided = sided_lineitem(spark, sf_dir).withColumn(
        "l_extendedprice", F.when(F.col("side") == "cur", F.col("l_extendedprice") * 1.5 / 1.1).otherwise(F.col("l_extendedprice"))
    )
    return rounded(rca.drift_hypothesis(sided, NUMERIC, CATEGORICAL))


IMPORTANCE_SQL = f"""{SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id, metric ORDER BY ts DESC) AS rn FROM series),
   t AS (SELECT model_id, metric AS feature, max(value) FILTER (rn = 1) / 100 AS c, max(value) FILTER (rn = 2) / 100 AS p FROM r WHERE rn <= 2 GROUP BY ALL),
   ih AS (SELECT 'perf_002' AS hypothesis_id, 'feature_importance_shift' AS category, 'medium' AS severity, count(DISTINCT feature) AS findings, least(1.0, count(DISTINCT feature) * 0.3)::DOUBLE AS confidence FROM t WHERE abs(c - p) > 0.1 HAVING count(*) > 0)"""


def _importance_changes(spark, sf_dir):
    history = daily_series(spark, sf_dir).select("model_id", F.col("metric").alias("feature"), "ts", (F.col("value") / 100).alias("importance"))
    return windows.importance_change(history)


@query("rca_importance_hypothesis", f"WITH {IMPORTANCE_SQL} SELECT hypothesis_id, category, severity, findings, round(confidence, 6) AS confidence FROM ih")
def _importance_hypothesis(spark, sf_dir):
    return rounded(rca.importance_hypothesis(_importance_changes(spark, sf_dir)))


QUALITY_SQL = DEGRADED_SQL + ", qk AS (SELECT unnest(string_split(affected_by, ';')) AS k FROM deg WHERE affected_by <> ''), qh AS (SELECT 'perf_003' AS hypothesis_id, 'data_quality' AS category, 'high' AS severity, count(*) AS findings, least(1.0, count(*) * 0.25)::DOUBLE AS confidence FROM qk HAVING count(*) > 0)"


def _sides(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    new = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return events.where(new).withColumn("user_id", F.when(F.col("event_id") % 6 != 0, F.col("user_id"))), events.where(~new)


@query("rca_quality_hypothesis", QUALITY_SQL + " SELECT * FROM qh")
def _quality_hypothesis(spark, sf_dir):
    cur, ref = _sides(spark, sf_dir)
    return rca.quality_hypothesis(cur, ref, ["value", "user_id", "event_type"])


HYPOTHESES_SQL = QUALITY_SQL + f", {IMPORTANCE_SQL}, hy AS (SELECT * FROM ih UNION ALL SELECT * FROM qh), rk AS (SELECT *, confidence * CASE severity WHEN 'high' THEN 0.8 ELSE 0.6 END AS score FROM hy), rr AS (SELECT *, row_number() OVER (ORDER BY score DESC, hypothesis_id)::INTEGER AS rank FROM rk), ro AS (SELECT *, CASE WHEN rank = 1 THEN 'primary' WHEN rank <= 3 THEN 'contributing' ELSE 'other' END AS role FROM rr)"


def hypotheses(spark, sf_dir):
    cur, ref = _sides(spark, sf_dir)
    both = rca.importance_hypothesis(_importance_changes(spark, sf_dir)).unionByName(rca.quality_hypothesis(cur, ref, ["value", "user_id", "event_type"]))
    return materialise(both)


@query("rca_rank_hypotheses", HYPOTHESES_SQL + " SELECT hypothesis_id, category, severity, findings, round(confidence, 6) AS confidence, round(score, 6) AS score, rank, role FROM ro")
def _rank(spark, sf_dir):
    return rounded(rca.rank_hypotheses(hypotheses(spark, sf_dir)))


CONFIDENCE_SQL = """, cf AS (SELECT count(*) AS hypothesis_count, avg(confidence) AS overall_confidence, max(confidence) AS top_confidence,
   (SELECT (count(*) - count(user_id)) / count(*)::DOUBLE / 3 FROM cur) AS missing_rate FROM hy),
   cg AS (SELECT *, CASE WHEN overall_confidence >= 0.8 THEN 'high' WHEN overall_confidence >= 0.6 THEN 'medium' WHEN overall_confidence >= 0.4 THEN 'moderate' ELSE 'low' END AS confidence_level,
     CASE WHEN missing_rate > 0.2 THEN 'poor' WHEN missing_rate > 0.1 THEN 'moderate' ELSE 'good' END AS data_quality FROM cf)"""


def _confidence(spark, sf_dir, found):
    return rca.analysis_confidence(found, _sides(spark, sf_dir)[0].select("value", "user_id", "event_type"))


@query("rca_analysis_confidence", HYPOTHESES_SQL + CONFIDENCE_SQL + " SELECT hypothesis_count, round(overall_confidence, 6) AS overall_confidence, round(top_confidence, 6) AS top_confidence, confidence_level, round(missing_rate, 6) AS missing_rate, data_quality FROM cg")
def _analysis_confidence(spark, sf_dir):
    return rounded(_confidence(spark, sf_dir, hypotheses(spark, sf_dir)))


CAUSE_RULES = [
    ("data_drift", "primary", "immediate", "D1"),
    ("feature_importance_shift", "primary", "immediate", "F1"),
    ("data_quality", "primary", "immediate", "Q1"),
    ("feature_importance_shift", "contributing", "short_term", "F2"),
    ("data_quality", "contributing", "short_term", "Q2"),
    (None, None, "strategic", "S1"),
]
STEP_RULES = [("primary_cause", "data_quality", "Q9"), ("primary_cause", "feature_importance_shift", "F9"), ("low_confidence", None, "L9"), ("follow_up", None, "R9")]


@query("rca_recommendations", HYPOTHESES_SQL + """ SELECT 'immediate' AS priority, CASE category WHEN 'data_drift' THEN 'D1' WHEN 'data_quality' THEN 'Q1' ELSE 'F1' END AS code FROM ro WHERE role = 'primary'
   UNION ALL SELECT DISTINCT 'short_term', CASE category WHEN 'data_quality' THEN 'Q2' ELSE 'F2' END FROM ro WHERE role = 'contributing' AND category <> 'data_drift'
   UNION ALL SELECT 'strategic', 'S1' WHERE EXISTS (SELECT * FROM ro)""")
def _rca_recommendations(spark, sf_dir):
    rules = local_table(spark, CAUSE_RULES, "category string, role string, priority string, code string")
    return rca.recommendations(rca.rank_hypotheses(hypotheses(spark, sf_dir)), rules)


@query("rca_next_steps", HYPOTHESES_SQL + CONFIDENCE_SQL + """ SELECT 'primary_cause' AS reason, CASE category WHEN 'data_quality' THEN 'Q9' ELSE 'F9' END AS code FROM ro WHERE rank = 1 AND category <> 'data_drift'
   UNION ALL SELECT 'low_confidence', 'L9' FROM cg WHERE confidence_level = 'low' UNION ALL SELECT 'follow_up', 'R9'""")
def _next_steps(spark, sf_dir):
    found = hypotheses(spark, sf_dir)
    rules = local_table(spark, STEP_RULES, "reason string, category string, code string")
    return rca.next_steps(rca.rank_hypotheses(found), _confidence(spark, sf_dir, found), rules)


@query("rca_context", """SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-20' AND user_id % 5 = 2""")
def _context(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("model_id", F.col("user_id") % 5)
    return A.context(rows, "ts", 2, "2024-01-20", 48).select("event_id", "value")


@query("rca_protected_correlation", """WITH k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)), j AS (SELECT *, code * 10.0::DOUBLE + c_custkey % 7 AS proxy FROM customer JOIN k USING (c_mktsegment))
   SELECT 'c_acctbal' AS feature, round(corr(c_acctbal, code), 6) AS correlation, abs(corr(c_acctbal, code)) > 0.7 AS flagged FROM j UNION ALL SELECT 'proxy', round(corr(proxy, code), 6), abs(corr(proxy, code)) > 0.7 FROM j""")
def _protected(spark, sf_dir):
    from tallywatch.operators import preprocess

    rows = read(spark, sf_dir, "customer")
    coded = preprocess.label_encode(rows.select("c_custkey", F.col("c_mktsegment").alias("code")), ["code"])
    proxied = rows.join(coded, "c_custkey").withColumn("proxy", F.col("code") * 10.0 + F.col("c_custkey") % 7)
    return rounded(rca.protected_correlation(proxied, ["c_acctbal", "proxy"], "c_mktsegment"))


@query("rca_representation_gap", f"""WITH {SIDED_SQL}, {CAT_SQL} SELECT feature AS attribute, bucket AS grp, round(c_ref / n_ref::DOUBLE, 6) AS share_ref, round(c_cur / n_cur::DOUBLE, 6) AS share_cur, round(c_cur / n_cur::DOUBLE - c_ref / n_ref::DOUBLE, 6) AS gap,
   abs(c_cur / n_cur::DOUBLE - c_ref / n_ref::DOUBLE) > 0.1 AS flagged FROM catcnt""")
def _gap(spark, sf_dir):
    return rounded(rca.representation_gap(sided_lineitem(spark, sf_dir), CATEGORICAL))


@query("rca_sensitive_group_drift", f"""WITH {SIDED_SQL}, {CAT_SQL}, {DECILE_SQL} SELECT feature AS attribute, round(statistic, 6) AS psi, statistic > 0.1 AS drift_detected FROM psi WHERE feature IN (SELECT feature FROM cat)""")
def _group_drift(spark, sf_dir):
    return rounded(rca.sensitive_group_drift(sided_lineitem(spark, sf_dir), CATEGORICAL))


# ------------------------------------------------------------------ streams

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _json_records(spark, sf_dir):
    """Events as JSON texts, some without a value and some cut short."""
    rows = read(spark, sf_dir, "events")
    whole = F.to_json(F.struct("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"), "event_type"))
    return rows.select("event_id", F.when(F.col("event_id") % 17 == 0, F.substring(whole, 1, 10)).otherwise(whole).alias("body"))


VALIDATE_SQL = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'malformed' WHEN event_id % 10 = 0 THEN 'missing value' END AS error FROM events"""


@query("str_validate_records", VALIDATE_SQL)
def _validate(spark, sf_dir):
    checked = streams.validate_records(_json_records(spark, sf_dir), "body", "event_id bigint, value double, event_type string", ["event_id", "value"])
    return checked.select("event_id", "error")


METRICS_SQL = """SELECT date_trunc('hour', ts) AS window_start, count(*) AS records, round(count(*) / 3600.0::DOUBLE, 6) AS records_per_second, max(ts) AS last_received, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate FROM events GROUP BY 1"""


def _hourly(rows):
    return rounded(streams.stream_metrics(rows, failed=F.col("event_type") == "error").drop("mean_latency"))


@query("str_stream_metrics", METRICS_SQL)
def _stream_metrics(spark, sf_dir):
    return _hourly(read(spark, sf_dir, "events"))


@query("str_stream_metrics_live", METRICS_SQL)
def _stream_metrics_live(spark, sf_dir):
    """The same windows from a real stream over the file."""
    rows = streams.open_stream(spark, "parquet", EVENT_SCHEMA, sf_dir, pathGlobFilter="events.parquet")
    folder = f"{shared_folder(spark)}/hourly-{uuid.uuid4().hex}"
    return streams.run_complete(_hourly(rows), f"{folder}/out", f"{folder}/checkpoint")


@query("str_enrich", """SELECT e.event_id, c.c_mktsegment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""")
def _enrich(spark, sf_dir):
    dimension = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return streams.enrich(read(spark, sf_dir, "events"), dimension, "user_id").select("event_id", "c_mktsegment")


WINDOWED_SQL = """WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-11'), r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM ref),
   g AS (SELECT unnest(range(0, 50))::INTEGER AS b), rc AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS b, count(*) AS c FROM ref, r GROUP BY 1),
   cu AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS w, CAST(least(floor((least(greatest(value, lo), hi) - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS b, count(*) AS c FROM events, r WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY ALL),
   wn AS (SELECT w, sum(c) AS n FROM cu GROUP BY w),
   cells AS (SELECT wn.w, coalesce(rc.c, 0) AS a, coalesce(cu.c, 0) AS z, (SELECT n FROM r) AS nr, wn.n AS nc FROM wn CROSS JOIN g LEFT JOIN rc ON rc.b = g.b LEFT JOIN cu ON cu.b = g.b AND cu.w = wn.w),
   sh AS (SELECT w, a / nr::DOUBLE + 1e-10 AS p, z / nc::DOUBLE + 1e-10 AS q, CASE WHEN a = 0 THEN 0.001 ELSE a / nr::DOUBLE END AS fp, CASE WHEN z = 0 THEN 0.001 ELSE z / nc::DOUBLE END AS fq FROM cells),
   nm AS (SELECT w, p / sum(p) OVER v AS p, q / sum(q) OVER v AS q, fp / sum(fp) OVER v AS fp, fq / sum(fq) OVER v AS fq FROM sh WINDOW v AS (PARTITION BY w)),
   o AS (SELECT w, sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2) AS js, sum((fq - fp) * ln(fq / fp)) AS psi FROM nm GROUP BY w)
   SELECT w AS window_start, 'value' AS feature, round(js, 6) AS jensen_shannon, round(psi, 6) AS psi, js > 0.1 AS drift_detected FROM o"""


@query("str_windowed_drift", WINDOWED_SQL)
def _windowed_drift(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    old = F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")
    reference = streams.reference_bins(events.where(old), ["value"])
    counts = streams.windowed_counts(events.where(~old), reference, ["value"])
    return rounded(streams.windowed_drift(counts, reference))


def _arrivals(spark, rows, folder, run):
    """Rows come in three parts by time; after each the stream runs over what is new, from its own checkpoint."""
    days = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21")]
    third = F.when(F.col("ts") < days[0], 0).when(F.col("ts") < days[1], 1).otherwise(2)
    for part in range(3):
        rows.where(third == part).write.mode("append").parquet(f"{folder}/in")
        run(streams.open_stream(spark, "parquet", rows.schema, f"{folder}/in")).awaitTermination()


@query("str_rules_live", EVALUATE_SQL)
def _rules_live(spark, sf_dir):
    """Rules over a stream in several batches, cooldowns carried from batch to batch."""
    folder = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    rules = A.rule_table(spark, RULES)
    _arrivals(spark, metric_points(spark, sf_dir), folder, lambda stream: streams.run_rules(stream, rules, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out/alerts").drop("batch_id")


@query("str_frequency", """WITH d AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS batch FROM events)
   SELECT batch, count(*) AS records, round(avg(value), 6) AS mean_value, count(DISTINCT event_type) AS kinds FROM d GROUP BY batch""")
def _frequency_live(spark, sf_dir):
    """A monitor that looks at what is new every second; the later half of the rows arrives after its first look."""
    folder = f"{shared_folder(spark)}/frequency-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    later = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    rows.where(~later).write.parquet(f"{folder}/in")
    stream = streams.open_stream(spark, "parquet", rows.schema, f"{folder}/in")
    monitor = streams.start(stream, f"{folder}/checkpoint", streams.write_batches(f"{folder}/out"), "1 second")
    try:
        monitor.processAllAvailable()
        rows.where(later).write.mode("append").parquet(f"{folder}/in")
        monitor.processAllAvailable()
    finally:
        monitor.stop()
    seen = spark.read.parquet(f"{folder}/out").groupBy(F.least(F.col("batch_id"), F.lit(1)).cast("int").alias("batch"))
    return rounded(seen.agg(F.count(F.lit(1)).alias("records"), F.avg("value").alias("mean_value"), F.countDistinct("event_type").alias("kinds")))


@query("str_fan_out", "SELECT 'columns' AS target, event_id, value FROM events UNION ALL SELECT 'text', event_id, value FROM events")
def _fan_out_live(spark, sf_dir):
    folder = f"{shared_folder(spark)}/fan-{uuid.uuid4().hex}"
    targets = [{"path": f"{folder}/columns", "format": "parquet"}, {"path": f"{folder}/text", "format": "json"}, {"path": f"{folder}/off", "enabled": False}]
    rows = read(spark, sf_dir, "events").select("event_id", "value", "ts")
    _arrivals(spark, rows, folder, lambda stream: streams.start(stream, f"{folder}/checkpoint", streams.fan_out(targets), once=True))
    columns = spark.read.parquet(f"{folder}/columns").select(F.lit("columns").alias("target"), "event_id", "value")
    return columns.unionByName(spark.read.schema("event_id bigint, value double").json(f"{folder}/text").select(F.lit("text").alias("target"), "event_id", "value"))


@query("str_validate_live", VALIDATE_SQL)
def _validate_live(spark, sf_dir):
    """Valid and rejected records of a stream go to tables of their own."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    _json_records(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = streams.open_stream(spark, "parquet", spark.read.parquet(f"{folder}/in").schema, f"{folder}/in")
    checked = streams.validate_records(stream, "body", "event_id bigint, value double, event_type string", ["event_id", "value"])
    for name, part in (("valid", streams.valid_records(checked)), ("rejected", streams.rejected_records(checked))):
        streams.start(part.select("event_id", "error"), f"{folder}/checkpoint-{name}", streams.write_batches(f"{folder}/{name}"), once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/valid").drop("batch_id").unionByName(spark.read.parquet(f"{folder}/rejected").drop("batch_id"))


@query("str_drift_live", WINDOWED_SQL)
def _drift_live(spark, sf_dir):
    """Drift of a stream's daily windows against a stored reference."""
    folder = f"{shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").select("ts", "value")
    old = F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")
    reference = streams.reference_bins(events.where(old), ["value"])
    events.where(~old).write.parquet(f"{folder}/in")
    stream = streams.open_stream(spark, "parquet", events.schema, f"{folder}/in")
    counts = streams.run_complete(streams.windowed_counts(stream, reference, ["value"]), f"{folder}/out", f"{folder}/checkpoint")
    return rounded(streams.windowed_drift(counts, reference))
