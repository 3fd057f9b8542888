"""Root-cause hypotheses from drift, importance and quality findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.bands import band
from tallywatch.operators import drift as D
from tallywatch.operators import quality as Q
from tallywatch.operators import summaries as S
from tallywatch.operators.aggregates import correlation

# Weight of a severity.
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4}


def _hypothesis(found: DataFrame, name: str, category: str, severity: str, step: float) -> DataFrame:
    """One row when anything was found: (hypothesis_id, category, severity, findings, confidence)."""
    return found.agg(F.count(F.lit(1)).alias("findings")).where("findings > 0").select(
        F.lit(name).alias("hypothesis_id"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        "findings",
        F.least(F.lit(1.0), F.col("findings") * step).alias("confidence"),
    )


def drift_hypothesis(sided: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Features that drift by Jensen-Shannon or PSI; confidence 0.2 each."""
    report = D.detect_drift(sided, numeric, categorical, ["jensen_shannon_divergence", "population_stability_index"])
    return _hypothesis(D.feature_scores(report).where("drift_detected"), "perf_001", "data_drift", "high", 0.2)


def importance_hypothesis(changes: DataFrame) -> DataFrame:
    """Features whose importance moved by more than 0.1; confidence 0.3 each."""
    moved = changes.where("changed").select("feature").distinct()
    return _hypothesis(moved, "perf_002", "feature_importance_shift", "medium", 0.3)


def quality_hypothesis(cur: DataFrame, ref: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Degraded columns; confidence 0.25 each (a column with gaps and outliers counts twice)."""
    kinds = Q.quality_degradation(cur, ref, columns).select(F.explode(F.split("affected_by", ";")).alias("kind"))
    return _hypothesis(kinds, "perf_003", "data_quality", "high", 0.25)


def rank_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """Score = confidence x severity weight; the first is the primary cause, the next two contribute."""
    weights = F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHTS.items() for x in pair])
    scored = hypotheses.withColumn("score", F.col("confidence") * F.coalesce(F.try_element_at(weights, F.col("severity")), F.lit(0.4)))
    # A handful of hypotheses: one small window.
    ranked = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "hypothesis_id")))
    return ranked.withColumn("role", F.when(F.col("rank") == 1, "primary").when(F.col("rank") <= 3, "contributing").otherwise("other"))


def analysis_confidence(hypotheses: DataFrame, cur: DataFrame | None = None) -> DataFrame:
    """Mean confidence, its level, and a grade for the share of missing cells."""
    out = hypotheses.agg(
        F.count(F.lit(1)).alias("hypothesis_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("overall_confidence"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("top_confidence"),
    ).withColumn("confidence_level", band(F.col("overall_confidence"), (0.8, 0.6, 0.4), ("high", "medium", "moderate", "low")))
    if cur is None:
        return out.withColumn("data_quality", F.lit("unknown"))
    rate = Q.missing_counts(cur).agg(F.avg(F.col("missing") / F.col("rows")).alias("r")).select("r").scalar()
    return out.withColumn("missing_rate", rate).withColumn(
        "data_quality", band(F.col("missing_rate"), (0.2, 0.1), ("poor", "moderate", "good"), inclusive=False)
    )


def recommendations(ranked: DataFrame, rules: DataFrame) -> DataFrame:
    """(priority, code): what the caller's ``rules`` (category, role, priority, code) call for.

    A rule holds for hypotheses of its category and role; a null category or role stands for any,
    hypotheses of role 'other' aside.
    """
    found = ranked.where("role <> 'other'").select(F.col("category").alias("_category"), F.col("role").alias("_role"))
    fits = (F.col("category").isNull() | (F.col("category") == F.col("_category"))) & (F.col("role").isNull() | (F.col("role") == F.col("_role")))
    # A handful of hypotheses meets a handful of rules.
    return rules.join(found, fits).select("priority", "code").distinct()


def next_steps(ranked: DataFrame, confidence: DataFrame, rules: DataFrame) -> DataFrame:
    """(reason, code) from ``rules`` (reason, category, code).

    Reason 'primary_cause' holds for the category of the first hypothesis, 'low_confidence' where confidence is low, and any other always.
    """
    primary = ranked.where("rank = 1").select("category")
    by_cause = rules.where("reason = 'primary_cause'").join(primary, "category").select("reason", "code")
    low = confidence.where("confidence_level = 'low'").select(F.lit("low_confidence").alias("reason"))
    by_confidence = rules.where("reason = 'low_confidence'").join(low, "reason").select("reason", "code")
    return by_cause.unionByName(by_confidence).unionByName(rules.where("reason NOT IN ('primary_cause', 'low_confidence')").select("reason", "code"))


def protected_correlation(df: DataFrame, features: Sequence[str], attribute: str, limit: float = 0.7) -> DataFrame:
    """Features whose correlation with the (sorted-coded) protected attribute exceeds ``limit``."""
    values = df.select(F.lit(attribute).alias("feature"), F.col(attribute).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    codes = S.ordered_codes(values).select(F.col("value").alias("_v"), F.col("code").cast("double").alias("_code"))
    rows = df.join(S.broadcast_if_small(codes), df[attribute].cast("string") == F.col("_v"))
    wide = rows.agg(*[correlation(S.clean(f), F.col("_code")).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "correlation").withColumn("flagged", F.abs("correlation") > limit)


def representation_gap(sided: DataFrame, attributes: Sequence[str], limit: float = 0.1) -> DataFrame:
    """(attribute, grp, share_ref, share_cur, gap, flagged)."""
    shares = D.align_distributions(S.value_counts_by_side(S.long_categorical(sided, attributes)))
    gap = F.col("share_cur") - F.col("share_ref")
    return shares.select(
        F.col("feature").alias("attribute"), F.col("category").alias("grp"), "share_ref", "share_cur", gap.alias("gap"), (F.abs(gap) > limit).alias("flagged")
    )


def sensitive_group_drift(sided: DataFrame, attributes: Sequence[str], limit: float = 0.1) -> DataFrame:
    """PSI of the group shares of each attribute."""
    h = D.category_counts(S.value_counts_by_side(S.long_categorical(sided, attributes)))
    return D.psi(h).select(F.col("feature").alias("attribute"), "psi", (F.col("psi") > limit).alias("drift_detected"))
