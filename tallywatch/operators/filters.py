"""Row and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.operators import summaries as S


def align_columns(ref: DataFrame, cur: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with their shared columns, in the reference's order."""
    shared = [c for c in ref.columns if c in set(cur.columns)]
    if not shared:
        raise ValueError("the two tables share no column")
    return ref.select(*shared), cur.select(*shared)


def split_by_time(df: DataFrame, ts: str, ref: tuple[str, str], cur: tuple[str, str]) -> DataFrame:
    """Rows of two closed time ranges tagged with ``side``; ranges may overlap."""
    inside = [
        F.when(F.col(ts).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")), F.lit(side))
        for side, (a, b) in (("ref", ref), ("cur", cur))
    ]
    # One scan for both ranges: a row in both is emitted twice.
    return df.withColumn("side", F.explode(F.array_compact(F.array(*inside))))


def split_by_position(df: DataFrame, key: str, ratio: float = 0.7) -> DataFrame:
    """The first ``int(n * ratio)`` rows by a unique key of any ordered type as 'ref', the rest as 'cur'.

    Only the key at the cut is searched for, in the key's own type; rows stay where they are. Null keys come last.
    """
    position = int(df.count() * ratio)
    keys = S.in_order(df.select(F.col(key).alias("key")).where("key IS NOT NULL"), "key")
    # One row per part of the stored keys.
    before, found = 0, None
    for row in keys.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).orderBy("slot").collect():
        if before < position <= before + row["n"]:
            rank = F.row_number().over(Window.orderBy("key"))
            found = keys.where(F.col("slot") == row["slot"]).withColumn("r", rank).where(F.col("r") == position - before).select("key").scalar()
        before += row["n"]
    if found is None:
        return df.withColumn("side", F.lit("ref") if position and position >= before else F.lit("cur"))
    return df.withColumn("side", F.when(F.col(key) <= found, "ref").otherwise("cur"))


def attach_labels(predictions: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Predictions with the label of their key, null where there is none; a key labelled more than once has its largest label."""
    known = labels.groupBy(key).agg(F.max(label).alias(label))
    return predictions.join(known, key, "left")


def drop_and_dropna(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Drop columns (absent ones are ignored), then rows with any null or NaN."""
    return df.drop(*columns).dropna("any")


def audit_trail(
    events: DataFrame,
    start: str | None = None,
    end: str | None = None,
    user_id: str | None = None,
    event_types: Sequence[str] | None = None,
    resource_type: str | None = None,
    risk_levels: Sequence[str] | None = None,
) -> DataFrame:
    """Audit events that meet all given conditions."""
    rows = events
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if event_types:
        rows = rows.where(F.col("event_type").isin(*event_types))
    if resource_type is not None:
        rows = rows.where(F.col("resource_type") == resource_type)
    if risk_levels:
        rows = rows.where(F.col("risk_level").isin(*risk_levels))
    return rows


def trail_page(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of ``limit`` rows (all without one), newest first, with the total count and whether more follow."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    page = rows.orderBy(F.col("ts").desc(), F.col("event_id")).offset(offset)
    more = F.lit(False) if limit is None else F.lit(offset + limit) < F.col("total_count")
    return (page if limit is None else page.limit(limit)).withColumn("total_count", total).withColumn("has_more", more)


def active_alerts(
    alerts: DataFrame, model_id: str | None = None, severities: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Alerts still open, newest first."""
    return model_alerts(
        alerts.where(F.col("status").isin("active", "acknowledged")), model_id, severities, limit
    )


def model_alerts(
    alerts: DataFrame, model_id: str | None = None, severities: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    rows = alerts
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    if severities:
        rows = rows.where(F.col("severity").isin(*severities))
    rows = rows.orderBy(F.col("triggered_at").desc(), F.col("alert_id"))
    return rows if limit is None else rows.limit(limit)


def text_search(df: DataFrame, term: str, columns: Sequence[str], **equals) -> DataFrame:
    """Case-insensitive substring in any of ``columns`` plus equality filters."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
    for c, value in equals.items():
        hit = hit & (F.col(c) == value)
    return df.where(hit)


# Named ranges in seconds.
RANGES = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}


def time_range_filter(df: DataFrame, ts: str, span: str, as_of: str) -> DataFrame:
    """Rows newer than ``as_of`` minus a named range."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(RANGES[span]))
    return df.where(F.col(ts) >= start)


def json_field(name: str, field: str) -> Column:
    return F.get_json_object(F.col(name), f"$.{field}")


def json_field_filter(df: DataFrame, column: str, field: str, value: str) -> DataFrame:
    return df.where(json_field(column, field) == value)
