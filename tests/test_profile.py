"""Profiles from two scans against plain numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallywatch.operators import aggregates as A
from tallywatch.operators import quality as Q
from tallywatch.operators import summaries as S


def table():
    r = np.random.default_rng(5)
    n = 30_000
    frame = pd.DataFrame({
        "skewed": np.exp(r.normal(0, 3, n)), "ties": r.integers(0, 4, n).astype(float), "constant": np.full(n, 2.5),
        "hot": np.where(r.random(n) < 0.6, 7.0, r.normal(0, 100, n)), "holes": np.where(r.random(n) < 0.3, np.nan, r.normal(size=n)),
    })
    frame["whole"] = r.integers(-10**6, 10**6, n)
    return frame


def test_describe_and_outliers_against_numpy(spark):
    frame = table()
    df = spark.createDataFrame(frame).repartition(7).withColumn("none", F.lit(None).cast("double"))
    described = {r.feature: r for r in A.describe(df).collect()}
    fences = {r.feature: r for r in Q.outlier_counts(df).collect()}
    assert set(described) == set(fences) == set(frame.columns)
    for c in frame.columns:
        v = frame[c].dropna().to_numpy(float)
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        d, f = described[c], fences[c]
        assert np.allclose([d.q25, d.q50, d.q75, d.mean, d.std, d.min, d.max], [q1, q2, q3, v.mean(), v.std(ddof=1), v.min(), v.max()], rtol=1e-9)
        outside = ((v < f.low) | (v > f.high)).sum()
        assert (f["values"], f.outliers) == (len(v), outside) and np.allclose([f.q1, f.q3], [q1, q3], rtol=1e-12)
        assert d["count"] == len(v)


def test_condensed_keeps_few_rows_and_survives_wrong_bounds(spark):
    frame = table()[["skewed"]]
    df = spark.createDataFrame(frame).repartition(5)
    looks, _ = S.first_look(df, ["skewed"], [0.5])
    kept = S.condensed(df, looks, [0.5])
    assert kept.count() < 100 and kept.agg(F.sum("n")).first()[0] == len(frame)
    wrong = [Row(**{**looks[0].asDict(), "bounds": [0.0, 1e-9]})]
    for counts in (kept, S.condensed(df, wrong, [0.5])):
        (row,) = S.exact_quantiles(counts, [0.5], weight="n").collect()
        assert np.isclose(row.quantile, np.median(frame["skewed"]), rtol=1e-12) and row.n == len(frame)


def test_profiles_of_small_and_empty_tables(spark):
    schema = "x double, y int, s string"
    one = spark.createDataFrame([(1.0, None, "a")], schema)
    assert [(r.q25, r.q75, r["count"]) for r in A.describe(one).collect()] == [(1.0, 1.0, 1)]
    (row,) = Q.assess_quality(one).collect()
    assert (row.rows, row.duplicate_rows, row.missing_values, row.columns_with_missing, row.outliers) == (1, 0, 1, 1, 0)
    parts = {r.feature: r for r in Q.profile(one).collect()}
    assert parts["x"].median == 1.0 and parts["y"].missing == 1 and parts["y"].median is None and parts["s"].top_values == "a=1"
    empty = spark.createDataFrame([], schema)
    assert A.describe(empty).count() == Q.outlier_counts(empty).count() == 0
    (row,) = Q.assess_quality(empty).collect()
    assert (row.rows, row.outliers, row.missing_values) == (0, 0, 0)
    assert {r.feature: r.rows for r in Q.profile(empty).collect()} == {"x": 0, "y": 0, "s": 0}
