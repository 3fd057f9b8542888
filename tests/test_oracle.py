"""Queries against their SQL twins on the smallest tables.

A quick selection by default; all of them with TALLYWATCH_ALL=1, or with
``python tests/oracle_compare.py --sf /root/testdata/sf0.01``.
"""

import os

import pytest
from oracle_compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = (
    "drf_jensen_shannon drf_psi drf_ks drf_chi_square drf_mmd drf_detect_drift drf_drift_trend qua_missing_counts qua_outliers_iqr "
    "qua_quality_rules pre_fill_missing pre_label_encode pre_train_validation_test_split pre_stratified_split agg_value_counts "
    "agg_metric_aggregation win_sliding_request_count win_waterfall top_values set_duplicates fun_sanitize_string fil_split_by_position "
    "fai_group_metrics fai_differences fai_compliance fai_optimal_thresholds prf_classification_metrics prf_roc_auc prf_threshold_curve "
    "abt_significance exp_permutation_importance exp_shap_kernel exp_ale exp_counterfactuals exp_decision_rules alr_evaluate_rules "
    "alr_lifecycle aud_classify_events kpi_metric_values rca_rank_hypotheses str_stream_metrics_live str_windowed_drift src_upsert_latest"
).split()


def names():
    return sorted(entry.oracle_sql()) if os.environ.get("TALLYWATCH_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
