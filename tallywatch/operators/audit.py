"""Audit log: retention, statistics, access patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.operators import ranking

# Years an event type is kept (7 where not named), and what always matters.
RETENTION_YEARS = {
    "user_login": 7, "user_logout": 7, "user_created": 10, "role_changed": 10, "model_deployed": 10, "model_prediction": 7,
    "bias_analysis": 10, "fairness_mitigation": 10, "data_accessed": 6, "data_exported": 10, "data_deleted": 10,
    "alert_triggered": 3, "configuration_changed": 7, "compliance_report_generated": 10, "audit_report_generated": 10,
}
DEFAULT_YEARS = 7
ALWAYS_RELEVANT = ("data_exported", "data_deleted", "bias_analysis", "model_deployed", "role_changed", "configuration_changed")
MANDATORY_EVENTS = {
    "gdpr": ("data_accessed", "data_exported", "data_deleted"),
    "eu_ai_act": ("bias_analysis", "model_deployed", "model_prediction"),
    "soc2": ("configuration_changed", "user_created", "role_changed"),
}
FRAMEWORK_YEARS = {"gdpr": 6}
PROCESSING_EVENTS = ("data_uploaded", "data_accessed", "data_exported", "data_deleted")


def classify_events(events: DataFrame, frameworks: Sequence[str] = ()) -> DataFrame:
    """Add compliance_relevant, retention_years and retention_until (years of 365 days)."""
    years = F.create_map(*[F.lit(x) for pair in RETENTION_YEARS.items() for x in pair])
    base = F.coalesce(F.try_element_at(years, F.col("event_type")), F.lit(DEFAULT_YEARS))
    for name in frameworks:
        base = F.greatest(base, F.lit(FRAMEWORK_YEARS.get(name, DEFAULT_YEARS)))
    relevant = set(ALWAYS_RELEVANT).union(*[MANDATORY_EVENTS.get(n, ()) for n in frameworks])
    return events.withColumns(
        {
            "compliance_relevant": F.col("event_type").isin(*sorted(relevant)),
            "retention_years": base,
            "retention_until": F.col("ts") + F.make_dt_interval(days=base * 365),
        }
    )


def in_period(events: DataFrame, start: str, end: str) -> DataFrame:
    return events.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def audit_statistics(events: DataFrame) -> DataFrame:
    """(kind, name, value): totals, counts by type and risk, distinct users, relevant events."""
    cells = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("events").alias("name")),
        F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("name")),
        F.struct(F.lit("risk").alias("kind"), F.col("risk_level").alias("name")),
        F.struct(F.lit("relevant").alias("kind"), F.when(F.col("compliance_relevant"), F.lit("events")).alias("name")),
    )
    counts = events.select(F.inline(cells)).where("name IS NOT NULL").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("value"))
    users = events.select("user_id").where("user_id IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("value"))
    return counts.unionByName(users.select(F.lit("users").alias("kind"), F.lit("distinct").alias("name"), "value"))


def security_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Risky, login and role events, newest first."""
    t = F.col("event_type")
    rows = events.where(F.col("risk_level").isin("high", "critical") | t.like("%login%") | t.like("%role%"))
    rows = rows.orderBy(F.col("ts").desc(), "event_id")
    return rows if limit is None else rows.limit(limit)


def events_by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def top_addresses(events: DataFrame, k: int = 20) -> DataFrame:
    return ranking.top_groups(events.where(F.col("ip_address").isNotNull()), ["ip_address"], k)


def processing_activities(events: DataFrame) -> DataFrame:
    """Data events by type and resource with count, first and last time."""
    rows = events.where(F.col("event_type").isin(*PROCESSING_EVENTS))
    return rows.groupBy("event_type", "resource_type", "resource_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_occurrence"), F.max("ts").alias("last_occurrence")
    )


def breach_incidents(events: DataFrame, pattern: str = "%security%") -> DataFrame:
    """High and critical events whose type is like ``pattern``."""
    return events.where(F.col("risk_level").isin("high", "critical") & F.col("event_type").like(pattern))


def retention_expired(events: DataFrame, as_of: str) -> DataFrame:
    return events.where(F.col("retention_until") < F.lit(as_of).cast("timestamp_ntz"))
