"""Group fairness of binary decisions.

Attributes are unpivoted to (attribute, grp), so any number of them runs in one job, and
every rate comes from four conditional counts per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.functions.bands import band, share
from tallywatch.operators import summaries as S
from tallywatch.operators.performance import LOG_CLIP, roc_auc
from tallywatch.session import local_table, materialise

RATES = (
    "base_rate", "selection_rate", "accuracy", "precision", "recall", "specificity", "f1_score", "true_positive_rate",
    "false_positive_rate", "true_negative_rate", "false_negative_rate", "positive_predictive_value",
    "negative_predictive_value", "false_discovery_rate", "false_omission_rate", "threat_score", "balanced_accuracy",
    "matthews_correlation",
)
COMPARED = (
    "selection_rate", "true_positive_rate", "false_positive_rate", "positive_predictive_value",
    "negative_predictive_value", "accuracy", "f1_score", "auc_roc",
)
DIFFERENCE_THRESHOLD = 0.1


def by_attribute(df: DataFrame, attributes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(attribute, grp, keep...): one row per row and attribute."""
    wide = df.select(*keep, *[F.col(a).cast("string").alias(a) for a in attributes])
    return wide.unpivot(list(keep), list(attributes), "attribute", "grp").where("grp IS NOT NULL")


def confusion_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, tn, fn per key from 0/1 columns y and yhat."""
    y, p = F.col("y") == 1, F.col("yhat") == 1
    return rows.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")
    )


def rates(counts: DataFrame) -> DataFrame:
    """All rates from confusion counts; a rate without cases is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n, pos, neg, sel, rej = tp + fp + tn + fn, tp + fn, tn + fp, tp + fp, tn + fn
    tpr, tnr = share(tp, pos), share(tn, neg)
    return counts.withColumns(
        {
            "sample_size": n.cast("bigint"),
            "base_rate": share(pos, n),
            "selection_rate": share(sel, n),
            "accuracy": share(tp + tn, n),
            "precision": share(tp, sel),
            "recall": tpr,
            "specificity": tnr,
            "f1_score": share(2 * tp, sel + pos),
            "true_positive_rate": tpr,
            "false_positive_rate": share(fp, neg),
            "true_negative_rate": tnr,
            "false_negative_rate": share(fn, pos),
            "positive_predictive_value": share(tp, sel),
            "negative_predictive_value": share(tn, rej),
            "false_discovery_rate": share(fp, sel),
            "false_omission_rate": share(fn, rej),
            "threat_score": share(tp, tp + fn + fp),
            "balanced_accuracy": (tpr + tnr) / 2,
            "matthews_correlation": share(tp * tn - fp * fn, F.sqrt(sel) * F.sqrt(pos) * F.sqrt(neg) * F.sqrt(rej)),
        }
    )


def group_metrics(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attribute, grp, counts, rates) for 0/1 columns y and yhat."""
    return rates(confusion_counts(by_attribute(df, attributes, ["y", "yhat"]), ["attribute", "grp"]))


def probability_metrics(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(attribute, grp, brier_score, log_loss, auc_roc, calibration_gap) for y and a probability p.

    AUC and log loss are null in a group with one class.
    """
    rows = by_attribute(df, attributes, ["y", "p"])
    clipped = F.least(F.greatest(F.col("p"), F.lit(LOG_CLIP)), F.lit(1 - LOG_CLIP))
    loss = -F.when(F.col("y") == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    plain = rows.groupBy("attribute", "grp").agg(
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier_score"),
        F.when((F.min("y") == 0) & (F.max("y") == 1), F.avg(loss)).alias("log_loss"),
        (F.avg("p") - F.avg(F.col("y").cast("double"))).alias("calibration_gap"),
    )
    auc = roc_auc(rows.select("attribute", "grp", F.col("p").alias("score"), F.col("y").alias("label")), ["attribute", "grp"])
    return plain.join(auc.select("attribute", "grp", F.col("auc").alias("auc_roc")), ["attribute", "grp"])


def calibration_fit(df: DataFrame, attributes: Sequence[str], penalty: float = 1.0, steps: int = 12) -> DataFrame:
    """Slope and intercept of a logistic fit of y on p per group, slope penalised by ``penalty`` / 2 * slope^2.

    Newton's method on (p, count, positives). All groups advance in the same aggregate, their slopes
    and intercepts being a table that every step reads and writes, so there may be any number of groups.
    """
    keys = ["attribute", "grp"]
    table = materialise(
        by_attribute(df, attributes, ["y", "p"])
        .groupBy(*keys, "p")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )
    state = table.select(*keys).distinct().withColumns({"slope": F.lit(0.0), "intercept": F.lit(0.0)})
    q = F.lit(1.0) / (1.0 + F.exp(-(F.col("slope") * F.col("p") + F.col("intercept"))))
    w = F.col("n") * q * (1 - q)
    off = F.col("pos") - F.col("n") * q
    for _ in range(steps):
        sums = table.join(state, keys).groupBy(*keys).agg(
            F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.sum(off * F.col("p")).alias("gs"), F.sum(off).alias("gi"),
            (F.sum(w * F.col("p") * F.col("p")) + penalty).alias("hss"), F.sum(w * F.col("p")).alias("hsi"), F.sum(w).alias("hii"),
        ).withColumn("gs", F.col("gs") - penalty * F.col("slope"))
        det = F.col("hss") * F.col("hii") - F.col("hsi") * F.col("hsi")
        ds = F.when(det > 1e-12, (F.col("hii") * F.col("gs") - F.col("hsi") * F.col("gi")) / det).otherwise(0.0)
        di = F.when(det > 1e-12, (F.col("hss") * F.col("gi") - F.col("hsi") * F.col("gs")) / det).otherwise(0.0)
        state = materialise(
            sums.select(
                *keys, (F.col("slope") + ds).alias("slope"), (F.col("intercept") + di).alias("intercept"), F.greatest(F.abs(ds), F.abs(di)).alias("moved")
            )
        )
        if (state.agg(F.max("moved")).first()[0] or 0.0) < 1e-10:
            break
        state = state.drop("moved")
    return state.select(*keys, F.col("slope").alias("calibration_slope"), F.col("intercept").alias("calibration_intercept"))


def fairness_differences(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Largest gap between groups per attribute and metric, with ratio, violation and severity.

    The ratio is the smallest positive value over the largest. Selection rate also violates when
    the ratio is below 0.8. An attribute with one group has no rows.
    """
    names = [m for m in COMPARED if m in metrics.columns]
    long_df = metrics.select("attribute", "grp", *[F.col(m).cast("double") for m in names]).unpivot(
        ["attribute", "grp"], names, "metric", "value"
    )
    stats = (
        long_df.groupBy("attribute", "metric")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            (F.max("value") - F.min("value")).alias("difference"),
            F.coalesce(F.min(F.when(F.col("value") > 0, F.col("value"))), F.lit(0.0)).alias("_low"),
            F.max("value").alias("_high"),
        )
        .where("groups >= 2")
    )
    threshold = F.lit(DIFFERENCE_THRESHOLD)
    for name, value in (thresholds or {}).items():
        threshold = F.when(F.col("metric") == name, value).otherwise(threshold)
    ratio = F.when(F.col("_high") > 0, F.try_divide(F.col("_low"), F.col("_high"))).otherwise(1.0)
    wide = F.col("difference") > F.col("threshold")
    violation = wide | ((F.col("metric") == "selection_rate") & (F.col("ratio") < 0.8))
    return (
        stats.withColumns({"ratio": ratio, "threshold": threshold})
        .withColumn("violation", F.coalesce(violation, F.lit(False)))
        .withColumn(
            "severity",
            F.when(F.col("difference") > 2 * F.col("threshold"), "high").when(F.col("violation"), "medium").otherwise("low"),
        )
        .select("attribute", "metric", "groups", "difference", "ratio", "threshold", "violation", "severity")
    )


def attribute_summary(differences: DataFrame) -> DataFrame:
    """(attribute, violations, bias_detected, severity)."""
    high = F.count_if(F.col("severity") == "high")
    medium = F.count_if(F.col("severity") == "medium")
    level = F.when(high > 0, "high").when(medium > 1, "medium").when(medium > 0, "low").otherwise("minimal")
    return differences.groupBy("attribute").agg(
        F.count_if("violation").alias("violations"), F.max("violation").alias("bias_detected"), level.alias("severity")
    )


def analyze_attributes(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return attribute_summary(fairness_differences(group_metrics(df, attributes)))


INTERSECTIONAL = ("selection_rate", "accuracy", "true_positive_rate")


def intersectional_groups(df: DataFrame, attributes: Sequence[str], min_rows: int = 10) -> DataFrame:
    """Rates per combination of attribute values with at least ``min_rows`` rows."""
    rows = df.select("y", "yhat", F.concat_ws("_", *[F.coalesce(F.col(a).cast("string"), F.lit("null")) for a in attributes]).alias("grp"))
    return rates(confusion_counts(rows, ["grp"])).where(F.col("sample_size") >= min_rows)


def intersectional_violations(groups: DataFrame) -> DataFrame:
    """Metrics whose spread over the combinations exceeds 0.15; high above 0.25."""
    long_df = groups.select("grp", *INTERSECTIONAL).unpivot(["grp"], list(INTERSECTIONAL), "metric", "value")
    return (
        long_df.groupBy("metric")
        .agg(F.count(F.lit(1)).alias("groups"), (F.max("value") - F.min("value")).alias("max_difference"))
        .where("groups >= 2 AND max_difference > 0.15")
        .withColumn("severity", F.when(F.col("max_difference") > 0.25, "high").otherwise("medium"))
    )


# What each framework requires. 'ratio' rows need the value to be at least the threshold.
REQUIREMENTS = (
    ("EU_AI_Act", "demographic_parity_difference", 0.1, "max"),
    ("EU_AI_Act", "equalized_odds_difference", 0.1, "max"),
    ("US_EEOC", "selection_rate_difference", 0.2, "max"),
    ("US_EEOC", "disparate_impact_ratio", 0.8, "min"),
    ("GDPR", "demographic_parity_difference", 0.1, "max"),
    ("FDA", "calibration_difference", 0.05, "max"),
    ("FDA", "accuracy_difference", 0.05, "max"),
)


def compliance_measures(differences: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """(attribute, measure, value) under the names the frameworks use."""

    def diff(*metrics: str) -> Column:
        return F.max(F.when(F.col("metric").isin(*metrics), F.col("difference")))

    wide = differences.groupBy("attribute").agg(
        diff("selection_rate").alias("demographic_parity_difference"),
        diff("selection_rate").alias("selection_rate_difference"),
        diff("true_positive_rate", "false_positive_rate").alias("equalized_odds_difference"),
        diff("accuracy").alias("accuracy_difference"),
        F.max(F.when(F.col("metric") == "selection_rate", F.col("ratio"))).alias("disparate_impact_ratio"),
    )
    names = [c for c in wide.columns if c != "attribute"]
    out = wide.unpivot(["attribute"], names, "measure", "value")
    if probabilities is not None:
        gap = probabilities.groupBy("attribute").agg((F.max("calibration_gap") - F.min("calibration_gap")).alias("value"))
        out = out.unionByName(gap.select("attribute", F.lit("calibration_difference").alias("measure"), "value"))
    return out


def compliance(measures: DataFrame, frameworks: Sequence[str] | None = None) -> DataFrame:
    """(framework, attribute, measure, value, threshold, violated)."""
    table = local_table(measures.sparkSession,
        [r for r in REQUIREMENTS if frameworks is None or r[0] in frameworks],
        "framework string, measure string, threshold double, kind string",
    )
    broken = F.when(F.col("kind") == "max", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return measures.join(F.broadcast(table), "measure").select(
        "framework", "attribute", "measure", "value", "threshold", broken.alias("violated")
    )


def compliance_status(checks: DataFrame) -> DataFrame:
    return checks.groupBy("framework").agg(
        F.count_if("violated").alias("violations"),
        F.when(F.max("violated"), "non_compliant").otherwise("compliant").alias("status"),
    )


def overall_score(differences: DataFrame) -> DataFrame:
    """Mean of 100 - 50 * min(difference / threshold, 2), and its level."""
    part = F.greatest(F.lit(0.0), 100 - 50 * F.least(F.col("difference") / F.col("threshold"), F.lit(2.0)))
    return differences.agg(F.coalesce(F.avg(part), F.lit(0.0)).alias("fairness_score")).withColumn(
        "fairness_level", band(F.col("fairness_score"), (80, 60, 40, 20), ("excellent", "good", "concerning", "poor", "critical"))
    )


def risk_assessment(score: DataFrame, attributes: DataFrame, status: DataFrame) -> DataFrame:
    """Legal, reputational, operational and financial risk, the highest of them, and the priority."""
    one = F.lit(1)
    merged = (
        score.withColumn("_k", one)
        .join(attributes.agg(F.count_if(F.col("severity") == "high").alias("_high")).withColumn("_k", one), "_k")
        .join(status.agg(F.count_if(F.col("status") == "non_compliant").alias("_broken")).withColumn("_k", one), "_k")
        .drop("_k")
    )
    s = F.col("fairness_score")
    rows = merged.withColumns(
        {
            "legal_risk": F.when(F.col("_broken") > 0, "high").otherwise("low"),
            "reputational_risk": F.when(s < 40, "high").when(s < 60, "medium").otherwise("low"),
            "operational_risk": F.when(F.col("_high") > 1, "high").when(F.col("_high") > 0, "medium").otherwise("low"),
        }
    )
    highs = sum(((F.col(c) == "high").cast("int") for c in ("legal_risk", "reputational_risk", "operational_risk")), F.lit(0))
    rows = rows.withColumn("financial_risk", F.when(highs >= 2, "high").when(highs >= 1, "medium").otherwise("low"))
    kinds = [F.col(c) for c in ("legal_risk", "reputational_risk", "operational_risk", "financial_risk")]
    any_of = lambda level: F.array_contains(F.array(*kinds), level)
    return rows.select(
        "fairness_score",
        *kinds,
        F.when(any_of("high"), "high").when(any_of("medium"), "medium").otherwise("low").alias("overall_risk_level"),
        F.when(s < 20, "immediate").when(s < 40, "high").otherwise("medium").alias("mitigation_priority"),
    )


def recommendations(score: DataFrame, metrics: DataFrame, attributes: DataFrame, status: DataFrame) -> DataFrame:
    """(priority, category, subject) rows the analysis calls for."""

    def rows(df: DataFrame, when: Column, priority: str, category: str, subject: Column) -> DataFrame:
        return df.where(when).select(F.lit(priority).alias("priority"), F.lit(category).alias("category"), subject.alias("subject"))

    s = F.col("fairness_score")
    small = metrics.where(F.col("sample_size") < 100).select("attribute").distinct()
    everything = F.lit("all")
    out = rows(score, s < 20, "immediate", "model_intervention", everything)
    for extra in (
        rows(small, F.lit(True), "high", "data_collection", F.col("attribute")),
        rows(attributes, F.col("severity").isin("high", "medium"), "high", "bias_mitigation", F.col("attribute")),
        rows(status, F.col("status") == "non_compliant", "immediate", "compliance", F.col("framework")),
        rows(score, s < 80, "medium", "monitoring", everything),
        rows(score, F.lit(True), "medium", "documentation", everything),
    ):
        out = out.unionByName(extra)
    return out


def fairness_dashboard(score: DataFrame, attributes: DataFrame, advice: DataFrame) -> DataFrame:
    """One row of headline figures: score, level, biased attributes, and recommendations by priority."""
    one = F.lit(1)
    left = score.withColumn("_k", one)
    middle = attributes.agg(
        F.count(F.lit(1)).alias("attributes_analyzed"), F.count_if("bias_detected").alias("violations_detected")
    ).withColumn("_k", one)
    right = advice.agg(
        *[F.count_if(F.col("priority") == p).alias(f"{p}_recommendations") for p in ("immediate", "high", "medium")]
    ).withColumn("_k", one)
    return left.join(middle, "_k").join(right, "_k").drop("_k")


NOTE_SCHEMA = "level string, check string, subject string"


def validate_fairness(df: DataFrame, target: str, attributes: Sequence[str], frameworks: Sequence[str] = ()) -> DataFrame:
    """(level, check, subject) for wide fairness data: columns, size, group counts."""
    absent = [c for c in [target, *attributes] if c not in df.columns]
    present = [a for a in attributes if a in df.columns]
    spark = df.sparkSession
    out = local_table(spark, [("error", "missing_column", c) for c in absent], NOTE_SCHEMA)
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    notes = [F.when(F.col("n") < 1000, F.struct(F.lit("warning").alias("level"), F.lit("small_dataset").alias("check"), F.lit("all").alias("subject")))]
    if "EU_AI_Act" in frameworks:
        notes.append(F.when(F.col("n") < 5000, F.struct(F.lit("recommendation").alias("level"), F.lit("larger_dataset").alias("check"), F.lit("EU_AI_Act").alias("subject"))))
    if "FDA" in frameworks and "medical" not in df.columns:
        out = out.unionByName(local_table(spark, [("recommendation", "medical_data", "FDA")], NOTE_SCHEMA))
    out = out.unionByName(rows.select(F.inline(F.array_compact(F.array(*notes)))))
    if present:
        groups = by_attribute(df, present, []).groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("n"))
        per = groups.groupBy("attribute").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
        level = F.when(F.col("k") < 2, "error").when(F.col("least") < 50, "warning")
        check = F.when(F.col("k") < 2, "fewer_than_two_groups").otherwise("small_groups")
        out = out.unionByName(per.select(level.alias("level"), check.alias("check"), F.col("attribute").alias("subject")).where("level IS NOT NULL"))
    return out


def validate_fairness_binary(df: DataFrame, target: str, attribute: str) -> DataFrame:
    """(level, check): the stricter variant for a binary target and one attribute."""
    classes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    groups = df.where(F.col(attribute).isNotNull()).groupBy(attribute).agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(1)
    facts = (
        classes.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).withColumn("_k", one)
        .join(groups.agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("least")).withColumn("_k", one), "_k")
    )
    entry = lambda when, level, check: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(check).alias("check")))
    return facts.select(
        F.inline(
            F.array_compact(
                F.array(
                    entry(F.col("rows") < 100, "warning", "small_dataset"),
                    entry(F.col("k") != 2, "issue", "target_not_binary"),
                    entry((F.col("k") == 2) & (F.col("lo") / F.col("hi") < 0.1), "warning", "class_imbalance"),
                    entry(F.col("g") < 2, "issue", "fewer_than_two_groups"),
                    entry((F.col("g") >= 2) & (F.col("least") < 10), "warning", "small_groups"),
                )
            )
        )
    )


FRAME = ("accuracy", "selection_rate", "sample_size", "true_positive_rate", "false_positive_rate")


def metric_frame(df: DataFrame, attribute: str, prediction: str = "yhat") -> DataFrame:
    """The frame metrics per group and for 'overall', from one grouped pass."""
    rows = df.select("y", F.col(prediction).alias("yhat"), F.col(attribute).cast("string").alias("grp"))
    counts = confusion_counts(rows, ["grp"])
    whole = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]).withColumn("grp", F.lit("overall"))
    return rates(counts.unionByName(whole)).select("grp", *FRAME)


def parity_differences(frame: DataFrame) -> DataFrame:
    """demographic_parity_difference, equalized_odds_difference and the level fair / concerning / unfair."""
    groups = frame.where("grp <> 'overall'")
    gap = lambda c: F.max(c) - F.min(c)
    out = groups.agg(
        gap("selection_rate").alias("demographic_parity_difference"),
        F.greatest(gap("true_positive_rate"), gap("false_positive_rate")).alias("equalized_odds_difference"),
    )
    worst = F.greatest(F.abs("demographic_parity_difference"), F.abs("equalized_odds_difference"))
    return out.withColumn("level", F.when(worst <= 0.1, "fair").when(worst <= 0.2, "concerning").otherwise("unfair"))


def mitigation_report(df: DataFrame, attribute: str, baseline: str, mitigated: str) -> DataFrame:
    """Accuracy change and improvement of both differences from one prediction column to another."""
    both = df.select(
        "y", attribute, F.explode(F.array(
            F.struct(F.lit("before").alias("version"), F.col(baseline).alias("yhat")),
            F.struct(F.lit("after").alias("version"), F.col(mitigated).alias("yhat")),
        )).alias("_v"),
    ).select("y", F.col(attribute).cast("string").alias("grp"), "_v.version", "_v.yhat")
    counts = confusion_counts(both, ["version", "grp"])
    sums = counts.groupBy("version").agg(((F.sum("tp") + F.sum("tn")) / (F.sum("tp") + F.sum("tn") + F.sum("fp") + F.sum("fn"))).alias("accuracy"))
    gap = lambda c: F.max(c) - F.min(c)
    gaps = rates(counts).groupBy("version").agg(
        gap("selection_rate").alias("dp"), F.greatest(gap("true_positive_rate"), gap("false_positive_rate")).alias("eo")
    )
    at = lambda v, c: F.max(F.when(F.col("version") == v, F.col(c)))
    return sums.join(gaps, "version").agg(
        at("before", "accuracy").alias("accuracy_before"),
        at("after", "accuracy").alias("accuracy_after"),
        (at("after", "accuracy") - at("before", "accuracy")).alias("accuracy_change"),
        (at("before", "dp") - at("after", "dp")).alias("demographic_parity_improvement"),
        (at("before", "eo") - at("after", "eo")).alias("equalized_odds_improvement"),
    )


def optimal_thresholds(df: DataFrame, attribute: str, constraint: str = "demographic_parity", parts: int = 100) -> DataFrame:
    """Per-group thresholds i / parts that bring groups to a common rate at the best accuracy.

    A score histogram per group gives the selection rate (or true-positive rate) and the number
    of right decisions at every threshold. For each target rate every group takes its nearest
    threshold; the target with most right decisions wins, lower targets on ties.
    """
    if constraint not in ("demographic_parity", "equalized_odds"):
        raise ValueError(f"unknown constraint: {constraint}")
    from tallywatch.operators.performance import threshold_curve

    rows = df.select(F.col(attribute).cast("string").alias("grp"), F.col("p").alias("score"), F.col("y").alias("label"))
    sizes = rows.groupBy("grp").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    curve = threshold_curve(rows, ["grp"], parts).join(sizes, "grp")
    rate = (
        share(F.col("tp") + F.col("fp"), F.col("pos") + F.col("neg")) if constraint == "demographic_parity" else F.col("tpr")
    )
    points = curve.select("grp", "threshold", rate.alias("rate"), (F.col("tp") + F.col("neg") - F.col("fp")).alias("right"))
    targets = points.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(parts)))).withColumn("target", F.col("target") / parts)
    nearest = targets.groupBy("target", "grp").agg(
        F.min_by(F.struct("threshold", "rate", "right"), F.struct(F.round(F.abs(F.col("rate") - F.col("target")), 9), "threshold")).alias("b")
    )
    best = nearest.groupBy("target").agg(F.sum("b.right").alias("right")).agg(
        F.max_by("target", F.struct("right", -F.col("target"))).alias("target")
    )
    return nearest.join(F.broadcast(best), "target").select(
        "grp", F.col("b.threshold").alias("threshold"), F.col("b.rate").alias("rate"), "target"
    )


def apply_thresholds(df: DataFrame, attribute: str, thresholds: DataFrame, name: str = "mitigated") -> DataFrame:
    """Decide with each group's own threshold."""
    table = thresholds.select(F.col("grp").alias("_grp"), F.col("threshold").alias("_t"))
    joined = df.join(S.broadcast_if_small(table), df[attribute].cast("string") == F.col("_grp"), "left")
    return joined.withColumn(name, F.when(F.col("p") >= F.col("_t"), 1).otherwise(0)).drop("_grp", "_t")


def reweighing(df: DataFrame, attribute: str, target: str = "y") -> DataFrame:
    """Rows with ``weight`` = P(a) P(y) / P(a, y), which makes label rates equal over groups.

    Rows without a group, or without a label, are a group, or a label, of their own.
    """
    cells = df.groupBy(attribute, target).agg(F.count(F.lit(1)).alias("_n"))
    of = lambda *keys: F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    weight = of(attribute).cast("double") * of(target) / (of() * F.col("_n"))
    return S.null_safe_join(df, cells.select(attribute, target, weight.alias("weight")), [attribute, target], "left")


def baseline_model(df: DataFrame, features: Sequence[str], key: Sequence[str], kind: str = "logistic_regression", seed: int = 42):
    """Fit on a stratified 80% of the rows; returns (model, scored test rows with yhat and p)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tallywatch.operators.preprocess import stratified_split

    makers = {
        "logistic_regression": lambda: LogisticRegression(labelCol="y", maxIter=50),
        "random_forest": lambda: RandomForestClassifier(labelCol="y", numTrees=100, seed=seed),
    }
    if kind not in makers:
        raise ValueError(f"unknown model: {kind}")
    rows = stratified_split(df, key, "y", 0.2, seed)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    # A fit reads its rows several times and keeps its own copy of each part in memory.
    train = materialise(rows.where("split = 'train'").select(*features, "y"))
    model = makers[kind]().fit(vectors.transform(S.spread_out(train)))
    scored = model.transform(vectors.transform(rows.where("split = 'test'"))).select(
        *[c for c in df.columns if c not in ("yhat", "p")],
        F.col("prediction").cast("int").alias("yhat"),
        vector_to_array("probability")[1].alias("p"),
    )
    return model, scored
