"""Fairness, performance and A/B queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywatch.operators import abtest as B
from tallywatch.operators import drift
from tallywatch.operators import fairness as X
from tallywatch.operators import reductions as R
from tallywatch.operators import performance as M
from tallywatch.plans.bindings import SIDED_SQL, query, read, rounded, sided_lineitem
from tallywatch.plans.drift_queries import HISTORY_SQL, drift_history
from tallywatch.plans.table_queries import SERIES_SQL, daily_series
from tallywatch.session import materialise

# ------------------------------------------------------------------ binding

DEC = """dec AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, l_linestatus AS status, quarter(l_shipdate)::VARCHAR AS season,
   (l_returnflag = 'R')::INTEGER AS y, (l_discount >= CASE WHEN l_linestatus = 'O' THEN 0.07::DOUBLE ELSE 0.04::DOUBLE END)::INTEGER AS yhat,
   least(l_discount * 10, 1.0::DOUBLE) AS p, l_quantity, l_tax FROM lineitem)"""


def decisions(spark, sf_dir):
    """Line items as decisions: y returned, yhat by a discount limit that differs by status, p from the discount."""
    limit = F.when(F.col("l_linestatus") == "O", 0.07).otherwise(0.04)
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        F.col("l_linestatus").alias("status"),
        F.quarter("l_shipdate").cast("string").alias("season"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") >= limit).cast("int").alias("yhat"),
        F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("p"),
        "l_quantity",
        "l_tax",
    )


ATTRIBUTES = ("status", "season")


def _cells(source: str = "dec", attributes=ATTRIBUTES) -> str:
    return "cells AS (" + " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a}::VARCHAR AS grp, y, yhat, p FROM {source}" for a in attributes) + ")"


def _rates(source: str, keys: str, name: str = "rt") -> str:
    return f"""{name}_c AS (SELECT {keys}, count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
     count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 1 AND yhat = 0) AS fn FROM {source} GROUP BY {keys}),
{name}_d AS (SELECT *, (tp + fp + tn + fn)::DOUBLE AS n, (tp + fn)::DOUBLE AS pos, (tn + fp)::DOUBLE AS neg, (tp + fp)::DOUBLE AS sel, (tn + fn)::DOUBLE AS rej FROM {name}_c),
{name} AS (SELECT {keys}, tp, fp, tn, fn, n::BIGINT AS sample_size, coalesce(pos / nullif(n, 0), 0) AS base_rate, coalesce(sel / nullif(n, 0), 0) AS selection_rate, coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy,
     coalesce(tp / nullif(sel, 0), 0) AS "precision", coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(tn / nullif(neg, 0), 0) AS specificity,
     coalesce(2.0::DOUBLE * tp / nullif(sel + pos, 0), 0) AS f1_score, coalesce(tp / nullif(pos, 0), 0) AS true_positive_rate, coalesce(fp / nullif(neg, 0), 0) AS false_positive_rate,
     coalesce(tn / nullif(neg, 0), 0) AS true_negative_rate, coalesce(fn / nullif(pos, 0), 0) AS false_negative_rate, coalesce(tp / nullif(sel, 0), 0) AS positive_predictive_value,
     coalesce(tn / nullif(rej, 0), 0) AS negative_predictive_value, coalesce(fp / nullif(sel, 0), 0) AS false_discovery_rate, coalesce(fn / nullif(rej, 0), 0) AS false_omission_rate,
     coalesce(tp / nullif((tp + fn + fp)::DOUBLE, 0), 0) AS threat_score, (coalesce(tp / nullif(pos, 0), 0) + coalesce(tn / nullif(neg, 0), 0)) / 2 AS balanced_accuracy,
     coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt(sel) * sqrt(pos) * sqrt(neg) * sqrt(rej), 0), 0) AS matthews_correlation FROM {name}_d)"""


ROUNDED_RATES = ", ".join(f'round("{r}", 6) AS "{r}"' for r in X.RATES)
METRICS = [m for m in X.COMPARED if m != "auc_roc"]
DIFF = (
    "lng AS ("
    + " UNION ALL ".join(f"SELECT attribute, grp, '{m}' AS metric, {m} AS value FROM rt" for m in METRICS)
    + """),
dif0 AS (SELECT attribute, metric, count(*) AS groups, max(value) - min(value) AS difference, coalesce(min(value) FILTER (value > 0), 0) AS lo, max(value) AS hi FROM lng GROUP BY ALL HAVING count(*) >= 2),
dif AS (SELECT attribute, metric, groups, difference, CASE WHEN hi > 0 THEN lo / hi ELSE 1 END AS ratio, 0.1::DOUBLE AS threshold,
   difference > 0.1 OR (metric = 'selection_rate' AND CASE WHEN hi > 0 THEN lo / hi ELSE 1 END < 0.8) AS violation FROM dif0),
diff AS (SELECT *, CASE WHEN difference > 0.2 THEN 'high' WHEN violation THEN 'medium' ELSE 'low' END AS severity FROM dif),
att AS (SELECT attribute, count(*) FILTER (violation) AS violations, bool_or(violation) AS bias_detected,
   CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'high' WHEN count(*) FILTER (severity = 'medium') > 1 THEN 'medium'
        WHEN count(*) FILTER (severity = 'medium') > 0 THEN 'low' ELSE 'minimal' END AS severity FROM diff GROUP BY attribute)"""
)
BASE = f"WITH {DEC}, {_cells()}, {_rates('cells', 'attribute, grp')}, {DIFF}"


@query("fai_group_metrics", f"WITH {DEC}, {_cells()}, {_rates('cells', 'attribute, grp')} SELECT attribute, grp, tp, fp, tn, fn, sample_size, {ROUNDED_RATES} FROM rt")
def _group_metrics(spark, sf_dir):
    return rounded(X.group_metrics(decisions(spark, sf_dir), ATTRIBUTES))


DOC = "dec AS (SELECT d.lang, d.source, l.quality AS y, (d.n_chars > 500)::INTEGER AS yhat, 0.5::DOUBLE AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def document_decisions(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(
        "lang", "source", F.col("quality").alias("y"), (F.col("n_chars") > 500).cast("int").alias("yhat"), F.lit(0.5).alias("p")
    )


@query("fai_group_metrics_documents", f"WITH {DOC}, {_cells('dec', ('lang', 'source'))}, {_rates('cells', 'attribute, grp')} SELECT attribute, grp, tp, fp, tn, fn, sample_size, {ROUNDED_RATES} FROM rt")
def _group_metrics_documents(spark, sf_dir):
    return rounded(X.group_metrics(document_decisions(spark, sf_dir), ["lang", "source"]))


AUC_SQL = """rk AS (SELECT attribute, grp, p, y, rank() OVER (PARTITION BY attribute, grp ORDER BY p) + (count(*) OVER (PARTITION BY attribute, grp, p) - 1) / 2.0::DOUBLE AS r FROM cells),
prob AS (SELECT attribute, grp, avg((p - y) ** 2) AS brier_score, CASE WHEN min(y) = 0 AND max(y) = 1 THEN
   -avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) ELSE ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END) END AS log_loss,
   avg(p) - avg(y) AS calibration_gap,
   (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0), 0) AS auc_roc
   FROM rk GROUP BY attribute, grp)"""


@query("fai_probability_metrics", f"WITH {DEC}, {_cells()}, {AUC_SQL} SELECT attribute, grp, round(brier_score, 6) AS brier_score, round(log_loss, 4) AS log_loss, round(calibration_gap, 6) AS calibration_gap, round(auc_roc, 6) AS auc_roc FROM prob")
def _probability(spark, sf_dir):
    return rounded(X.probability_metrics(decisions(spark, sf_dir), ATTRIBUTES), 6, log_loss=4)


@query("fai_calibration_fit")
def _calibration(spark, sf_dir):
    return rounded(X.calibration_fit(decisions(spark, sf_dir), ATTRIBUTES), 4)


def _differences(spark, sf_dir):
    return X.fairness_differences(X.group_metrics(decisions(spark, sf_dir), ATTRIBUTES))


@query("fai_differences", BASE + " SELECT attribute, metric, groups, round(difference, 6) AS difference, round(ratio, 6) AS ratio, threshold, violation, severity FROM diff")
def _diff(spark, sf_dir):
    return rounded(_differences(spark, sf_dir))


@query("fai_analyze_attributes", BASE + " SELECT * FROM att")
def _analyze(spark, sf_dir):
    return X.analyze_attributes(decisions(spark, sf_dir), ATTRIBUTES)


INTER = f"WITH {DEC}, ig AS (SELECT status || '_' || season AS grp, y, yhat FROM dec), {_rates('ig', 'grp')}"


@query("fai_intersectional", INTER + f" SELECT grp, tp, fp, tn, fn, sample_size, {ROUNDED_RATES} FROM rt WHERE sample_size >= 10")
def _intersectional(spark, sf_dir):
    return rounded(X.intersectional_groups(decisions(spark, sf_dir), ATTRIBUTES))


@query("fai_intersectional_violations", INTER + """, l AS (SELECT 'selection_rate' AS metric, selection_rate AS v FROM rt WHERE sample_size >= 10 UNION ALL SELECT 'accuracy', accuracy FROM rt WHERE sample_size >= 10
   UNION ALL SELECT 'true_positive_rate', true_positive_rate FROM rt WHERE sample_size >= 10)
   SELECT metric, count(*) AS groups, round(max(v) - min(v), 6) AS max_difference, CASE WHEN max(v) - min(v) > 0.25 THEN 'high' ELSE 'medium' END AS severity FROM l
   GROUP BY metric HAVING max(v) - min(v) > 0.15""")
def _intersectional_violations(spark, sf_dir):
    return rounded(X.intersectional_violations(X.intersectional_groups(decisions(spark, sf_dir), ATTRIBUTES)))


COMPLIANCE = f"""{AUC_SQL},
ms AS (SELECT attribute, 'demographic_parity_difference' AS measure, max(difference) FILTER (metric = 'selection_rate') AS value FROM diff GROUP BY 1
   UNION ALL SELECT attribute, 'selection_rate_difference', max(difference) FILTER (metric = 'selection_rate') FROM diff GROUP BY 1
   UNION ALL SELECT attribute, 'equalized_odds_difference', max(difference) FILTER (metric IN ('true_positive_rate', 'false_positive_rate')) FROM diff GROUP BY 1
   UNION ALL SELECT attribute, 'accuracy_difference', max(difference) FILTER (metric = 'accuracy') FROM diff GROUP BY 1
   UNION ALL SELECT attribute, 'disparate_impact_ratio', max(ratio) FILTER (metric = 'selection_rate') FROM diff GROUP BY 1
   UNION ALL SELECT attribute, 'calibration_difference', max(calibration_gap) - min(calibration_gap) FROM prob GROUP BY 1),
rq AS (SELECT * FROM (VALUES ('EU_AI_Act', 'demographic_parity_difference', 0.1::DOUBLE, 1), ('EU_AI_Act', 'equalized_odds_difference', 0.1, 1), ('US_EEOC', 'selection_rate_difference', 0.2, 1),
   ('US_EEOC', 'disparate_impact_ratio', 0.8, 0), ('GDPR', 'demographic_parity_difference', 0.1, 1), ('FDA', 'calibration_difference', 0.05, 1), ('FDA', 'accuracy_difference', 0.05, 1)) t(framework, measure, threshold, up)),
comp AS (SELECT framework, attribute, measure, value, threshold, CASE WHEN up = 1 THEN value > threshold ELSE value < threshold END AS violated FROM ms JOIN rq USING (measure)),
st AS (SELECT framework, count(*) FILTER (violated) AS violations, CASE WHEN bool_or(violated) THEN 'non_compliant' ELSE 'compliant' END AS status FROM comp GROUP BY framework),
sc0 AS (SELECT coalesce(avg(greatest(0, 100 - 50 * least(difference / threshold, 2))), 0) AS fairness_score FROM diff),
sc AS (SELECT fairness_score, CASE WHEN fairness_score >= 80 THEN 'excellent' WHEN fairness_score >= 60 THEN 'good' WHEN fairness_score >= 40 THEN 'concerning'
   WHEN fairness_score >= 20 THEN 'poor' ELSE 'critical' END AS fairness_level FROM sc0)"""
FULL = BASE + ", " + COMPLIANCE


def _checks(spark, sf_dir):
    rows = decisions(spark, sf_dir)
    return X.compliance(X.compliance_measures(_differences(spark, sf_dir), X.probability_metrics(rows, ATTRIBUTES)))


@query("fai_compliance", FULL + " SELECT framework, attribute, measure, round(value, 6) AS value, threshold, violated FROM comp")
def _compliance(spark, sf_dir):
    return rounded(_checks(spark, sf_dir))


@query("fai_compliance_status", FULL + " SELECT * FROM st")
def _status(spark, sf_dir):
    return X.compliance_status(_checks(spark, sf_dir))


@query("fai_overall_score", FULL + " SELECT round(fairness_score, 4) AS fairness_score, fairness_level FROM sc")
def _score(spark, sf_dir):
    return rounded(X.overall_score(_differences(spark, sf_dir)), 4)


def _analysis(spark, sf_dir):
    """The few rows the report parts share, computed once."""
    differences = materialise(_differences(spark, sf_dir))
    rows = decisions(spark, sf_dir)
    status = X.compliance_status(X.compliance(X.compliance_measures(differences, X.probability_metrics(rows, ATTRIBUTES))))
    return X.overall_score(differences), X.attribute_summary(differences), materialise(status)


@query("fai_risk_assessment", FULL + """, r AS (SELECT fairness_score, CASE WHEN (SELECT count(*) FROM st WHERE status = 'non_compliant') > 0 THEN 'high' ELSE 'low' END AS legal_risk,
   CASE WHEN fairness_score < 40 THEN 'high' WHEN fairness_score < 60 THEN 'medium' ELSE 'low' END AS reputational_risk,
   CASE WHEN (SELECT count(*) FROM att WHERE severity = 'high') > 1 THEN 'high' WHEN (SELECT count(*) FROM att WHERE severity = 'high') > 0 THEN 'medium' ELSE 'low' END AS operational_risk FROM sc),
   h AS (SELECT *, (legal_risk = 'high')::INT + (reputational_risk = 'high')::INT + (operational_risk = 'high')::INT AS k FROM r),
   f AS (SELECT *, CASE WHEN k >= 2 THEN 'high' WHEN k >= 1 THEN 'medium' ELSE 'low' END AS financial_risk FROM h)
   SELECT round(fairness_score, 4) AS fairness_score, legal_risk, reputational_risk, operational_risk, financial_risk,
   CASE WHEN 'high' IN (legal_risk, reputational_risk, operational_risk, financial_risk) THEN 'high' WHEN 'medium' IN (legal_risk, reputational_risk, operational_risk, financial_risk) THEN 'medium' ELSE 'low' END AS overall_risk_level,
   CASE WHEN fairness_score < 20 THEN 'immediate' WHEN fairness_score < 40 THEN 'high' ELSE 'medium' END AS mitigation_priority FROM f""")
def _risk(spark, sf_dir):
    return rounded(X.risk_assessment(*_analysis(spark, sf_dir)), 4)


ADVICE = """adv AS (SELECT 'immediate' AS priority, 'model_intervention' AS category, 'all' AS subject FROM sc WHERE fairness_score < 20
   UNION ALL SELECT DISTINCT 'high', 'data_collection', attribute FROM rt WHERE sample_size < 100
   UNION ALL SELECT 'high', 'bias_mitigation', attribute FROM att WHERE severity IN ('high', 'medium')
   UNION ALL SELECT 'immediate', 'compliance', framework FROM st WHERE status = 'non_compliant'
   UNION ALL SELECT 'medium', 'monitoring', 'all' FROM sc WHERE fairness_score < 80
   UNION ALL SELECT 'medium', 'documentation', 'all' FROM sc)"""


@query("fai_recommendations", FULL + f", {ADVICE} SELECT * FROM adv")
def _advice(spark, sf_dir):
    score, attributes, status = _analysis(spark, sf_dir)
    return X.recommendations(score, X.group_metrics(decisions(spark, sf_dir), ATTRIBUTES), attributes, status)


@query("fai_dashboard", FULL + f""", {ADVICE} SELECT round(fairness_score, 4) AS fairness_score, fairness_level, (SELECT count(*) FROM att) AS attributes_analyzed,
   (SELECT count(*) FROM att WHERE bias_detected) AS violations_detected, (SELECT count(*) FROM adv WHERE priority = 'immediate') AS immediate_recommendations,
   (SELECT count(*) FROM adv WHERE priority = 'high') AS high_recommendations, (SELECT count(*) FROM adv WHERE priority = 'medium') AS medium_recommendations FROM sc""")
def _dashboard(spark, sf_dir):
    score, attributes, status = _analysis(spark, sf_dir)
    advice = X.recommendations(score, X.group_metrics(decisions(spark, sf_dir), ATTRIBUTES), attributes, status)
    return rounded(X.fairness_dashboard(score, attributes, advice), 4)


@query("fai_validate", """SELECT 'error' AS level, 'missing_column' AS check, 'income' AS subject FROM customer LIMIT 1""".replace("FROM customer LIMIT 1", "") + """
   UNION ALL SELECT 'warning', 'small_dataset', 'all' FROM labels HAVING count(*) < 1000 UNION ALL SELECT 'recommendation', 'larger_dataset', 'EU_AI_Act' FROM labels HAVING count(*) < 5000
   UNION ALL SELECT 'recommendation', 'medical_data', 'FDA'
   UNION ALL SELECT CASE WHEN count(*) < 2 THEN 'error' ELSE 'warning' END, CASE WHEN count(*) < 2 THEN 'fewer_than_two_groups' ELSE 'small_groups' END, 'lang'
     FROM (SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) HAVING count(*) < 2 OR min(n) < 50
   UNION ALL SELECT CASE WHEN count(*) < 2 THEN 'error' ELSE 'warning' END, CASE WHEN count(*) < 2 THEN 'fewer_than_two_groups' ELSE 'small_groups' END, 'source'
     FROM (SELECT source, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source) HAVING count(*) < 2 OR min(n) < 50""")
def _validate(spark, sf_dir):
    return X.validate_fairness(document_decisions(spark, sf_dir), "y", ["lang", "source", "income"], ["EU_AI_Act", "FDA"])


@query("fai_validate_binary", """WITH t AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), g AS (SELECT source, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
   SELECT * FROM (SELECT 'warning' AS level, 'small_dataset' AS check FROM t HAVING sum(n) < 100 UNION ALL SELECT 'issue', 'target_not_binary' FROM t HAVING count(*) <> 2
   UNION ALL SELECT 'warning', 'class_imbalance' FROM t HAVING count(*) = 2 AND min(n) / max(n)::DOUBLE < 0.1 UNION ALL SELECT 'issue', 'fewer_than_two_groups' FROM g HAVING count(*) < 2
   UNION ALL SELECT 'warning', 'small_groups' FROM g HAVING count(*) >= 2 AND min(n) < 10)""")
def _validate_binary(spark, sf_dir):
    rows = document_decisions(spark, sf_dir).withColumn("group", F.concat_ws("_", "source", "lang"))
    return X.validate_fairness_binary(rows, "y", "group")


FRAME = f"""WITH {DEC}, {_rates('dec', 'status')}, {_rates("(SELECT 'overall' AS status, y, yhat FROM dec)", 'status', 'ov')}, fr AS (SELECT * FROM rt UNION ALL SELECT * FROM ov)"""


@query("fai_metric_frame", FRAME + """ SELECT status AS grp, round(accuracy, 6) AS accuracy, round(selection_rate, 6) AS selection_rate, sample_size, round(true_positive_rate, 6) AS true_positive_rate,
   round(false_positive_rate, 6) AS false_positive_rate FROM fr""")
def _frame(spark, sf_dir):
    return rounded(X.metric_frame(decisions(spark, sf_dir), "status"))


PARITY = """, pd AS (SELECT max(selection_rate) - min(selection_rate) AS d, greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate)) AS e FROM rt)
   SELECT round(d, 6) AS demographic_parity_difference, round(e, 6) AS equalized_odds_difference, CASE WHEN greatest(d, e) <= 0.1 THEN 'fair' WHEN greatest(d, e) <= 0.2 THEN 'concerning' ELSE 'unfair' END AS level FROM pd"""


@query("fai_parity_differences", FRAME + PARITY)
def _parity(spark, sf_dir):
    return rounded(X.parity_differences(X.metric_frame(decisions(spark, sf_dir), "status")))


THRESH = f"""WITH {DEC}, g AS (SELECT unnest(range(0, 101))::INTEGER AS i), b AS (SELECT status AS grp, y, CAST(least(greatest(floor(p * 100), 0), 100) AS INTEGER) AS bucket FROM dec),
   c AS (SELECT b.grp, g.i, count(*) FILTER (y = 1 AND bucket >= g.i) AS tp, count(*) FILTER (y = 0 AND bucket >= g.i) AS fp, count(*) FILTER (y = 0) AS neg, count(*) AS n FROM b, g GROUP BY ALL),
   pt AS (SELECT grp, i / 100.0::DOUBLE AS threshold, (tp + fp) / n::DOUBLE AS rate, tp + neg - fp AS ok FROM c),
   nr AS (SELECT t.i / 100.0::DOUBLE AS target, grp, threshold, rate, ok, row_number() OVER (PARTITION BY t.i, grp ORDER BY round(abs(rate - t.i / 100.0::DOUBLE), 9), threshold) AS rn FROM pt, g t),
   bt AS (SELECT target FROM nr WHERE rn = 1 GROUP BY target ORDER BY sum(ok) DESC, target LIMIT 1), th AS (SELECT grp, threshold, rate, nr.target FROM nr, bt WHERE rn = 1 AND nr.target = bt.target)"""


@query("fai_optimal_thresholds", THRESH + " SELECT grp, threshold, round(rate, 6) AS rate, target FROM th")
def _thresholds(spark, sf_dir):
    return rounded(X.optimal_thresholds(decisions(spark, sf_dir), "status"))


@query("fai_mitigation_report", THRESH + f""", m AS (SELECT dec.*, (p >= th.threshold)::INTEGER AS mit FROM dec JOIN th ON th.grp = dec.status),
   {_rates('(SELECT status, y, yhat FROM m)', 'status', 'rb')}, {_rates('(SELECT status, y, mit AS yhat FROM m)', 'status', 'ra')},
   bb AS (SELECT (sum(tp) + sum(tn)) / sum(sample_size)::DOUBLE AS acc, max(selection_rate) - min(selection_rate) AS d, greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate)) AS e FROM rb),
   aa AS (SELECT (sum(tp) + sum(tn)) / sum(sample_size)::DOUBLE AS acc, max(selection_rate) - min(selection_rate) AS d, greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate)) AS e FROM ra)
   SELECT round(bb.acc, 6) AS accuracy_before, round(aa.acc, 6) AS accuracy_after, round(aa.acc - bb.acc, 6) AS accuracy_change, round(bb.d - aa.d, 6) AS demographic_parity_improvement, round(bb.e - aa.e, 6) AS equalized_odds_improvement FROM aa, bb""")
def _mitigation(spark, sf_dir):
    rows = decisions(spark, sf_dir)
    mitigated = X.apply_thresholds(rows, "status", X.optimal_thresholds(rows, "status"))
    return rounded(X.mitigation_report(mitigated, "status", "yhat", "mitigated"))


@query("fai_reweighing", f"""WITH {DEC}, c AS (SELECT status, y, count(*) AS n FROM dec GROUP BY ALL)
   SELECT status, y, n, round(sum(n) OVER (PARTITION BY status)::DOUBLE * sum(n) OVER (PARTITION BY y) / (sum(n) OVER () * n), 6) AS weight FROM c""")
def _reweighing(spark, sf_dir):
    rows = X.reweighing(decisions(spark, sf_dir), "status")
    return rounded(rows.groupBy("status", "y").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))


@query("fai_dataset_info", f"""WITH {DEC} SELECT 'y' AS feature, y::VARCHAR AS value, count(*) AS n FROM dec GROUP BY y UNION ALL SELECT 'status', status, count(*) FROM dec GROUP BY status
   UNION ALL SELECT 'season', season, count(*) FROM dec GROUP BY season""")
def _info(spark, sf_dir):
    from tallywatch.operators.aggregates import value_counts

    return value_counts(decisions(spark, sf_dir), ["y", "status", "season"]).drop("share")


@query("fai_baseline_model")
def _baseline(spark, sf_dir):
    _, scored = X.baseline_model(decisions(spark, sf_dir), ["l_quantity", "l_tax", "p"], ["row_key"])
    return rounded(X.metric_frame(scored, "status"), 4)


@query("fai_baseline_forest")
def _forest(spark, sf_dir):
    _, scored = X.baseline_model(decisions(spark, sf_dir), ["l_quantity", "l_tax", "p"], ["row_key"], "random_forest")
    return rounded(X.metric_frame(scored, "season"), 4)


THREE = """th AS (SELECT l_returnflag AS grp, (l_quantity + 3 * l_linenumber > 30)::INTEGER AS y, l_quantity / 50 * CASE l_returnflag WHEN 'N' THEN 0.6::DOUBLE WHEN 'A' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS p FROM lineitem),
   ce AS MATERIALIZED (SELECT grp, y, least(floor(p * 100), 100)::INTEGER AS b, count(*) AS n FROM th GROUP BY ALL),
   sz AS MATERIALIZED (SELECT grp, sum(n)::DOUBLE AS n, sum(sum(n)) OVER ()::DOUBLE AS total FROM ce GROUP BY grp),
   ab AS MATERIALIZED (SELECT c.grp, c.y, t.b, coalesce(sum(ce.n), 0)::DOUBLE AS n FROM (SELECT DISTINCT grp, y FROM ce) c CROSS JOIN (SELECT unnest(range(0, 102))::INTEGER AS b) t LEFT JOIN ce ON ce.grp = c.grp AND ce.y = c.y AND ce.b >= t.b GROUP BY ALL)"""
ROUNDS, SLACK = 6, 0.02


def three_groups(spark, sf_dir):
    """Three groups whose score is biased: decisions y by quantity and line, score p scaled down for two of the groups."""
    flag = F.col("l_returnflag")
    scale = F.when(flag == "N", 0.6).when(flag == "A", 0.8).otherwise(1.0)
    return read(spark, sf_dir, "lineitem").select(
        flag.alias("grp"), (F.col("l_quantity") + 3 * F.col("l_linenumber") > 30).cast("int").alias("y"), (F.col("l_quantity") / 50 * scale).alias("p")
    )


def _best_sql(multipliers: str, keys: str = "") -> str:
    """Per group the lowest threshold of the least cost, given ``multipliers`` (keys, grp, m); all groups' multipliers add up in every cost."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""(SELECT {k}grp, b, m FROM (SELECT {k}grp, b, any_value(m) AS m, row_number() OVER (PARTITION BY {k}grp ORDER BY round(sum(cost * n), 9), b) AS i
       FROM (SELECT {k}ab.grp, ab.b, ab.n, m, (1 - 2 * y) + m * total / sz.n - ms AS cost FROM ab JOIN sz ON sz.grp = ab.grp JOIN (SELECT *, sum(m) OVER ({part}) AS ms FROM {multipliers}) u ON u.grp = ab.grp) GROUP BY {k}grp, b) WHERE i = 1)"""


def _game_sql() -> str:
    out = ["t0 AS MATERIALIZED (SELECT grp, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn FROM sz)"]
    for i in range(ROUNDS):
        out.append(f"m{i} AS MATERIALIZED (SELECT grp, up, dn, {1 / SLACK}::DOUBLE * (exp(up) - exp(dn)) / (1 + sum(exp(up) + exp(dn)) OVER ()) AS m FROM t{i})")
        out.append(f"b{i} AS MATERIALIZED {_best_sql(f'm{i}')}")
        out.append(f"r{i} AS MATERIALIZED (SELECT grp, s / n AS rate, s / n - sum(s) OVER () / total AS gap FROM (SELECT b.grp, sum(ab.n) AS s, any_value(sz.n) AS n, any_value(total) AS total FROM b{i} b JOIN ab USING (grp, b) JOIN sz ON sz.grp = b.grp GROUP BY b.grp))")
        out.append(f"t{i + 1} AS MATERIALIZED (SELECT grp, up + {2 * SLACK}::DOUBLE * (gap - {SLACK}::DOUBLE) AS up, dn + {2 * SLACK}::DOUBLE * (-gap - {SLACK}::DOUBLE) AS dn FROM m{i} JOIN r{i} USING (grp))")
    return ", ".join(out)


@query("fai_exponentiated_gradient", f"""WITH {THREE}, {_game_sql()}, lm AS (SELECT grp, b, m FROM ({" UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(ROUNDS))})),
   ch AS (SELECT th.grp, th.y, avg((least(floor(th.p * 100), 100) >= lm.b)::INTEGER) AS chance FROM (SELECT row_number() OVER () AS i, * FROM th) th JOIN lm ON lm.grp = th.grp GROUP BY th.i, th.grp, th.y)
   SELECT grp, count(*) AS n, round(avg(chance), 6) AS selection_rate, round(avg(CASE y WHEN 1 THEN chance ELSE 1 - chance END), 6) AS accuracy, (SELECT round(avg(m), 6) FROM lm WHERE lm.grp = ch.grp) AS multiplier FROM ch GROUP BY grp""")
def _gradient(spark, sf_dir):
    rows = three_groups(spark, sf_dir)
    mixture, history, _ = R.exponentiated_gradient(rows, "grp", R.ThresholdLearner("p", 100), rounds=ROUNDS, slack=SLACK)
    right = F.when(F.col("y") == 1, F.col("chance")).otherwise(1 - F.col("chance"))
    rates = mixture.score(rows).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("chance").alias("selection_rate"), F.avg(right).alias("accuracy"))
    return rounded(rates.join(history.groupBy(F.col("name").alias("grp")).agg(F.avg("multiplier").alias("multiplier")), "grp"))


def _grid_sql() -> str:
    points = R.multiplier_grid(["A", "N", "R"], 20)
    return "(VALUES " + ", ".join(f"({i}, '{g}', {m}::DOUBLE)" for i, p in enumerate(points) for g, m in p.items()) + ") v(point, grp, m)"


@query("fai_reduction_grid", f"""WITH {THREE}, gr AS MATERIALIZED (SELECT * FROM {_grid_sql()}), bt AS {_best_sql("gr", "point")},
   se AS (SELECT point, bt.grp, sum(ab.n) AS s, sum(CASE y WHEN 1 THEN ab.n ELSE 0 END) AS tp FROM bt JOIN ab USING (grp, b) GROUP BY point, bt.grp),
   ps AS (SELECT grp, sum(n) FILTER (y = 1) AS pos FROM ce GROUP BY grp),
   ag AS (SELECT point, sum(tp + sz.n - pos - (s - tp)) / any_value(total) AS accuracy, max(s / sz.n) - min(s / sz.n) AS difference FROM se JOIN sz USING (grp) JOIN ps USING (grp) GROUP BY point)
   SELECT point, (SELECT m FROM gr WHERE gr.point = ag.point AND grp = 'A') AS of_a, (SELECT m FROM gr WHERE gr.point = ag.point AND grp = 'N') AS of_n, (SELECT m FROM gr WHERE gr.point = ag.point AND grp = 'R') AS of_r,
     round(accuracy, 6) AS accuracy, round(difference, 6) AS difference, round(0.5 * (1 - accuracy) + 0.5 * difference, 6) AS objective FROM ag""")
def _grid(spark, sf_dir):
    _, table = R.reduction_grid(three_groups(spark, sf_dir), "grp", R.ThresholdLearner("p", 100), size=20)
    of = F.col("multipliers")
    return rounded(table.select("point", of["A"].alias("of_a"), of["N"].alias("of_n"), of["R"].alias("of_r"), "accuracy", "difference", "objective"))


# ------------------------------------------------------------------ performance

CLS = f"""cl AS (SELECT l_returnflag AS y, CASE WHEN l_discount < 0.04 THEN 'A' WHEN l_discount < 0.08 THEN 'N' ELSE 'R' END AS yh, l_linestatus AS side FROM lineitem)"""


def _classes(spark, sf_dir):
    d = F.col("l_discount")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("y"), F.when(d < 0.04, "A").when(d < 0.08, "N").otherwise("R").alias("yh"), F.col("l_linestatus").alias("side")
    )


def _weighted_sql(source: str) -> str:
    return f"""pc AS (SELECT c.cls, (SELECT count(*) FROM {source} WHERE y = c.cls) AS support, (SELECT count(*) FROM {source} WHERE yh = c.cls) AS predicted,
      (SELECT count(*) FROM {source} WHERE y = c.cls AND yh = c.cls) AS tp FROM (SELECT y AS cls FROM {source} UNION SELECT yh FROM {source}) c),
    wm AS (SELECT sum(support)::BIGINT AS n, sum(tp) / sum(support)::DOUBLE AS accuracy, sum(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) * support) / sum(support) AS "precision",
      sum(coalesce(tp / nullif(support, 0)::DOUBLE, 0) * support) / sum(support) AS recall, sum(coalesce(2.0::DOUBLE * tp / nullif(predicted + support, 0), 0) * support) / sum(support) AS f1_score FROM pc)"""


@query("prf_classification_metrics", f"""WITH {CLS}, {_weighted_sql('cl')} SELECT n, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM wm""")
def _classification(spark, sf_dir):
    return rounded(M.classification_metrics(_classes(spark, sf_dir), "y", "yh"))


REG = """rg AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), e AS (SELECT count(*) AS n, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae,
   1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p) / abs(y)) * 100 AS mape FROM rg)"""


def _regression_rows(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


@query("prf_regression_metrics", f"""WITH {REG} SELECT n, round(mse, 1) AS mse, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2_score,
   round(1 - (1 - r2) * (n - 1) / (n - 2), 4) AS adjusted_r2, round(mape, 4) AS mape FROM e""")
def _regression(spark, sf_dir):
    return rounded(M.regression_metrics(_regression_rows(spark, sf_dir), "y", "p"), 4, mse=1)


@query("prf_residuals", """WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, l_extendedprice - l_quantity * 1500 AS residual FROM lineitem)
   SELECT row_key, round(residual, 4) AS residual, round(residual / (SELECT stddev_pop(residual) FROM r), 4) AS standardised FROM r""")
def _residuals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")
    )
    return rounded(M.residuals(rows, "y", "p").select("row_key", "residual", "standardised"), 4)


@query("prf_roc_auc", """WITH r AS (SELECT (l_returnflag = 'R')::INTEGER AS y, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS r FROM lineitem)
   SELECT count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives,
   round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1)::DOUBLE * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def _auc(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(M.roc_auc(rows))


@query("prf_roc_auc_multiclass", """WITH s AS (SELECT 'A' AS cls, 0.1 - l_discount AS score, (l_returnflag = 'A')::INTEGER AS y FROM lineitem UNION ALL SELECT 'N', l_tax, (l_returnflag = 'N')::INTEGER FROM lineitem
   UNION ALL SELECT 'R', l_quantity, (l_returnflag = 'R')::INTEGER FROM lineitem), r AS (SELECT cls, y, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0::DOUBLE AS r FROM s),
   a AS (SELECT cls, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1)::DOUBLE * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY cls)
   SELECT round(avg(auc), 6) AS auc, count(*) AS classes FROM a""")
def _auc_multiclass(spark, sf_dir):
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("cls"), s.alias("score"), (F.col("l_returnflag") == c).cast("int").alias("label"))
            for c, s in (("A", F.lit(0.1) - F.col("l_discount")), ("N", F.col("l_tax")), ("R", F.col("l_quantity")))
        ]
    )
    return rounded(M.roc_auc_multiclass(read(spark, sf_dir, "lineitem").select(F.inline(cells))))


@query("prf_auto_metrics", f"""WITH {CLS}, {_weighted_sql('cl')}, {REG} SELECT 'classification' AS task, 'accuracy' AS metric, round(accuracy, 4) AS value FROM wm UNION ALL SELECT 'classification', 'precision', round("precision", 4) FROM wm
   UNION ALL SELECT 'classification', 'recall', round(recall, 4) FROM wm UNION ALL SELECT 'classification', 'f1_score', round(f1_score, 4) FROM wm
   UNION ALL SELECT 'regression', 'mae', round(mae, 4) FROM e UNION ALL SELECT 'regression', 'r2_score', round(r2, 4) FROM e""")
def _auto(spark, sf_dir):
    first = M.auto_metrics(_classes(spark, sf_dir), "y", "yh").withColumn("task", F.lit("classification"))
    second = M.auto_metrics(_regression_rows(spark, sf_dir), "y", "p").where("metric IN ('mae', 'r2_score')").withColumn("task", F.lit("regression"))
    return rounded(first.unionByName(second), 4)


@query("prf_threshold_curve", f"""WITH {DEC}, b AS (SELECT y, CAST(least(greatest(floor(p * 20), 0), 20) AS INTEGER) AS bucket FROM dec), g AS (SELECT unnest(range(0, 21))::INTEGER AS i),
   c AS (SELECT i, count(*) FILTER (y = 1 AND bucket >= i) AS tp, count(*) FILTER (y = 0 AND bucket >= i) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM b, g GROUP BY i)
   SELECT i / 20.0::DOUBLE AS threshold, tp, fp, round(tp / pos::DOUBLE, 6) AS tpr, round(fp / neg::DOUBLE, 6) AS fpr, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision" FROM c""")
def _curve(spark, sf_dir):
    return rounded(M.threshold_curve(decisions(spark, sf_dir).select(F.col("p").alias("score"), F.col("y").alias("label")), parts=20))


def _side_weighted(side: str, name: str) -> str:
    sql = _weighted_sql(f"(SELECT y, yh FROM s0 WHERE side = '{side}')")
    return sql.replace("pc AS", f"pc_{name} AS").replace("wm AS", f"wm_{name} AS").replace("FROM pc)", f"FROM pc_{name})")


@query("prf_performance_by_side", f"WITH {SIDED_SQL}, s0 AS (SELECT side, (l_returnflag = 'R')::INTEGER AS y, (l_extendedprice > 60000)::INTEGER AS yh FROM base), {_side_weighted('ref', 'r')}, {_side_weighted('cur', 'c')}" + """
   SELECT round(r.accuracy, 6) AS accuracy_ref, round(c.accuracy, 6) AS accuracy_cur, round(r.f1_score, 6) AS f1_score_ref, round(c.f1_score, 6) AS f1_score_cur, round(c.accuracy - r.accuracy, 6) AS accuracy_change,
   round(c.f1_score - r.f1_score, 6) AS f1_score_change, round((c.accuracy - r.accuracy) / r.accuracy, 6) AS relative_accuracy_change,
   CASE WHEN c.accuracy - r.accuracy < -0.05 THEN 'degraded' WHEN c.accuracy - r.accuracy > 0.05 THEN 'improved' ELSE 'stable' END AS interpretation FROM wm_r r, wm_c c""")
def _by_side(spark, sf_dir):
    rows = sided_lineitem(spark, sf_dir).select("side", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_extendedprice") > 60000).cast("int").alias("yh"))
    return rounded(M.performance_by_side(rows, "y", "yh"))


@query("prf_performance_by_side_regression", f"WITH {SIDED_SQL}," + """ m AS (SELECT side, avg((l_extendedprice - l_quantity * 1500) ** 2) AS mse,
   1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)) AS r2 FROM base GROUP BY side), x AS (SELECT max(mse) FILTER (side = 'ref') AS mr, max(mse) FILTER (side = 'cur') AS mc,
   max(r2) FILTER (side = 'ref') AS rr, max(r2) FILTER (side = 'cur') AS rc FROM m)
   SELECT round(mr, 1) AS mse_ref, round(mc, 1) AS mse_cur, round(rr, 4) AS r2_score_ref, round(rc, 4) AS r2_score_cur, round(mc - mr, 1) AS mse_change, round(rc - rr, 4) AS r2_score_change, round((mc - mr) / mr, 4) AS relative_mse_change,
   CASE WHEN rc - rr < -0.05 THEN 'degraded' WHEN rc - rr > 0.05 THEN 'improved' ELSE 'stable' END AS interpretation FROM x""")
def _by_side_regression(spark, sf_dir):
    rows = sided_lineitem(spark, sf_dir).select("side", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return rounded(M.performance_by_side(rows, "y", "p", "regression"), 4, mse_ref=1, mse_cur=1, mse_change=1)


TRACK = """tr AS (SELECT user_id % 5 AS model_id, CAST(ts AS DATE) AS batch, ts, (value > 40)::INTEGER AS prediction, CASE WHEN event_type <> 'error' THEN (event_type = 'purchase')::INTEGER END AS label, value / 10 AS revenue FROM events)"""


def tracked(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("model_id"),
        F.to_date("ts").alias("batch"),
        "ts",
        (F.col("value") > 40).cast("int").alias("prediction"),
        F.when(F.col("event_type") != "error", (F.col("event_type") == "purchase").cast("int")).alias("label"),
        (F.col("value") / 10).alias("revenue"),
    )


@query("prf_track_batches", f"""WITH {TRACK} SELECT model_id, batch, count(*) AS predictions, count(label) AS labelled, round(avg(prediction), 6) AS mean_prediction,
   round(avg(CASE WHEN label IS NOT NULL THEN (label = prediction)::INTEGER END), 6) AS accuracy, round(sum(revenue), 6) AS revenue, max(ts) AS last_ts FROM tr GROUP BY ALL""")
def _track(spark, sf_dir):
    return rounded(M.track_batches(tracked(spark, sf_dir)))


@query("prf_threshold_alerts", f"""WITH {TRACK}, b AS (SELECT model_id, batch AS ts, avg(CASE WHEN label IS NOT NULL THEN (label = prediction)::INTEGER END) AS value FROM tr GROUP BY ALL)
   SELECT model_id, ts, 'accuracy' AS metric, round(value, 6) AS value, 0.5::DOUBLE AS threshold, CASE WHEN abs(value - 0.5) > 0.5 * 0.1 THEN 'high' ELSE 'medium' END AS severity FROM b WHERE value < 0.5
   UNION ALL SELECT model_id, ts, 'error_rate', round(1 - value, 6), 0.6, CASE WHEN abs(1 - value - 0.6) > 0.6 * 0.1 THEN 'high' ELSE 'medium' END FROM b WHERE 1 - value > 0.6""")
def _alerts(spark, sf_dir):
    batches = M.track_batches(tracked(spark, sf_dir)).select("model_id", F.col("batch").alias("ts"), "accuracy", (1 - F.col("accuracy")).alias("error_rate"))
    long_df = batches.unpivot(["model_id", "ts"], ["accuracy", "error_rate"], "metric", "value")
    return rounded(M.threshold_alerts(long_df, [("accuracy", 0.5, "low"), ("error_rate", 0.6, "high")]))


@query("prf_business_impact", f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id, metric ORDER BY ts DESC) AS rn FROM series)
   SELECT model_id, metric, round(sum(value), 6) AS total, round(avg(value), 6) AS average, count(*) AS points,
   CASE WHEN max(value) FILTER (rn = 1) > max(value) FILTER (rn = 2) THEN 'positive' ELSE 'stable' END AS trend FROM r GROUP BY ALL""")
def _impact(spark, sf_dir):
    return rounded(M.business_impact(daily_series(spark, sf_dir)))


HEALTH = HISTORY_SQL + f""", {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id, metric ORDER BY ts DESC) AS rn FROM series),
   t AS (SELECT model_id, metric, (max(value) FILTER (rn = 1) - max(value) FILTER (rn = 2)) / max(value) FILTER (rn = 2) * 100 AS ch FROM r WHERE rn <= 2 GROUP BY ALL HAVING count(*) = 2),
   tt AS (SELECT model_id, count(*) FILTER (ch > 1) AS improving, count(*) FILTER (ch < -1) AS declining FROM t GROUP BY 1),
   v AS (SELECT model_id, sum(value) AS business_value, count(*) AS data_points FROM series GROUP BY 1),
   d AS (SELECT model_id, CASE WHEN arg_max(drift_detected, d) THEN 'drift_detected' ELSE 'stable' END AS current_status, count(*) FILTER (drift_detected) AS drift_events,
     count(*) FILTER (drift_detected) / count(*)::DOUBLE AS drift_frequency, arg_max(drift_score, d) AS latest_score FROM hist GROUP BY model_id),
   a AS (SELECT user_id % 5 AS model_id, count(*) AS total_alerts, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS recent_alerts, count(*) FILTER (ts >= TIMESTAMP '2024-01-24' AND value > 250) AS critical_alerts FROM events WHERE value > 100 GROUP BY 1)
   SELECT v.model_id, round(business_value, 4) AS business_value, data_points, coalesce(improving, 0) AS improving, coalesce(declining, 0) AS declining, current_status, drift_events, round(drift_frequency, 4) AS drift_frequency, round(latest_score, 4) AS latest_score,
   coalesce(total_alerts, 0) AS total_alerts, coalesce(recent_alerts, 0) AS recent_alerts, coalesce(critical_alerts, 0) AS critical_alerts,
   CASE WHEN critical_alerts > 0 THEN 'critical' WHEN current_status = 'drift_detected' THEN 'warning' WHEN business_value < 0 THEN 'business' ELSE 'success' END AS recommendation
   FROM v LEFT JOIN tt USING (model_id) LEFT JOIN d USING (model_id) LEFT JOIN a USING (model_id)"""


@query("prf_health_summary", HEALTH)
def _health(spark, sf_dir):
    alerts = read(spark, sf_dir, "events").where("value > 100").select(
        (F.col("user_id") % 5).alias("model_id"), F.col("ts").alias("triggered_at"), F.when(F.col("value") > 250, "high").otherwise("medium").alias("severity")
    )
    rows = M.health_summary(daily_series(spark, sf_dir), drift.drift_trend(drift_history(spark, sf_dir)), alerts, "2024-01-31")
    return rounded(rows, 4)


@query("prf_monitoring_stats", """SELECT (SELECT count(*) FROM customer) AS models, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS drift_check_enabled, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS performance_check_enabled,
   (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS quality_check_enabled, (SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) AS active_alerts""")
def _stats(spark, sf_dir):
    configs = read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 2 == 0).alias("drift_check"), (F.col("c_custkey") % 3 == 0).alias("performance_check"), (F.col("c_acctbal") > 0).alias("quality_check")
    )
    status = F.when(F.col("event_type") == "click", "active").when(F.col("event_type") == "view", "acknowledged").otherwise("resolved")
    return M.monitoring_stats(configs, read(spark, sf_dir, "events").select(status.alias("status")))


# ------------------------------------------------------------------ A/B tests

ARM = """ab AS (SELECT 'checkout' AS test_id, CASE WHEN ('0x' || substr(md5('checkout|' || user_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.4 THEN 'B' ELSE 'A' END AS arm, user_id,
   (event_type = 'purchase')::INTEGER AS success, value FROM events),
arms AS (SELECT test_id, arm, count(DISTINCT user_id) AS users, count(*) AS requests, sum(success)::BIGINT AS successes, sum(success) / count(*)::DOUBLE AS success_rate, avg(value) AS mean_value, var_samp(value) AS variance FROM ab GROUP BY ALL)"""


def ab_rows(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.lit("checkout").alias("test_id"), B.assign_arm("checkout", F.col("user_id"), 0.4).alias("arm"), "user_id",
        (F.col("event_type") == "purchase").cast("int").alias("success"), "value",
    )


@query("abt_assign_arm", f"WITH {ARM} SELECT arm, count(DISTINCT user_id) AS users, count(*) AS events FROM ab GROUP BY arm")
def _assign(spark, sf_dir):
    return ab_rows(spark, sf_dir).groupBy("arm").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"))


@query("abt_arm_metrics", f"WITH {ARM} SELECT test_id, arm, users, requests, successes, round(success_rate, 6) AS success_rate, round(mean_value, 6) AS mean_value, round(variance, 4) AS variance FROM arms")
def _arm_metrics(spark, sf_dir):
    return rounded(B.arm_metrics(ab_rows(spark, sf_dir)), 6, variance=4)


@query("abt_significance", f"""WITH {ARM}, w AS (SELECT a.test_id, a.requests AS na, b.requests AS nb, a.success_rate AS pa, b.success_rate AS pb, (a.successes + b.successes) / (a.requests + b.requests)::DOUBLE AS pp,
   a.mean_value AS ma, b.mean_value AS mb, a.variance / a.requests AS va, b.variance / b.requests AS vb FROM arms a JOIN arms b ON a.arm = 'A' AND b.arm = 'B'),
   z AS (SELECT *, (pb - pa) / sqrt(pp * (1 - pp) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS z, (mb - ma) / sqrt(va + vb) AS t, (va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)) AS dof FROM w)
   SELECT test_id, round(z, 4) AS z, round(t, 4) AS t, round(dof, 2) AS dof, na >= 100 AND nb >= 100 AS enough_samples, na >= 100 AND nb >= 100 AND abs(z) > 1.959963984540054 AS significant,
   CASE WHEN na >= 100 AND nb >= 100 AND abs(z) > 1.959963984540054 THEN CASE WHEN z > 0 THEN 'B' ELSE 'A' END ELSE 'none' END AS winner FROM z""")
def _significance(spark, sf_dir):
    rows = B.significance(B.arm_metrics(ab_rows(spark, sf_dir)))
    return rounded(rows.select("test_id", "z", "t", "dof", "enough_samples", "significant", "winner"), 4, dof=2)


TESTS = "ts AS (SELECT p_partkey AS test_id, CASE WHEN p_size < 15 THEN 'draft' WHEN p_size < 40 THEN 'running' ELSE 'done' END AS status, p_size * 30 AS current, 1000 AS target FROM part)"


def ab_tests(spark, sf_dir):
    s = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("test_id"), F.when(s < 15, "draft").when(s < 40, "running").otherwise("done").alias("status"), (s * 30).alias("current"), F.lit(1000).alias("target")
    )


@query("abt_progress", f"WITH {TESTS} SELECT test_id, status, current, target, round(least(current / target::DOUBLE * 100, 100), 6) AS progress FROM ts")
def _progress(spark, sf_dir):
    return rounded(B.progress(ab_tests(spark, sf_dir)))


@query("abt_status_counts", f"WITH {TESTS} SELECT status, count(*) AS n FROM ts GROUP BY status")
def _status_counts(spark, sf_dir):
    return B.status_counts(ab_tests(spark, sf_dir))
