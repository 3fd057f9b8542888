import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.functions import pvalues as P
from tallywatch.operators import drift as D
from tallywatch.operators import summaries as S


def test_published_tail_values():
    assert P.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert P.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert P.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert P.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert P.student_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert P.student_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6)


def _ad_by_hand(x, y):
    both = np.sort(np.concatenate([x, y]))
    total, values = len(both), np.unique(np.concatenate([x, y]))
    out = 0.0
    for sample in (x, y):
        n, part = len(sample), 0.0
        for v in values:
            ties = (both == v).sum()
            mid = (both < v).sum() + ties / 2
            upto = (sample < v).sum() + (sample == v).sum() / 2
            spread = mid * (total - mid) - total * ties / 4
            part += ties / total * (total * upto - mid * n) ** 2 / spread if spread else 0.0
        out += part / n
    return out * (total - 1) / total


def test_anderson_darling_is_standardised_under_the_null():
    rng = np.random.default_rng(1)
    draws = [P.anderson_darling_normalised(_ad_by_hand(rng.random(25), rng.random(30)), 25, 30) for _ in range(400)]
    assert abs(np.mean(draws)) < 0.15
    assert abs(np.std(draws) - 1) < 0.15
    # At the 5% critical value of the fit the p-value is close to 0.05.
    assert P.anderson_darling_p(1.645 + 0.678 - 0.362) == pytest.approx(0.05, abs=0.005)


@pytest.mark.parametrize("n", [1, 2, 4, 9, 10, 100, 1999, 5000])
def test_harmonic_sums_are_the_written_out_ones(n):
    h, squares = P.harmonic(n)
    assert h == pytest.approx(sum(1 / i for i in range(1, n + 1)), abs=2e-11)
    assert squares == pytest.approx(sum(1 / i**2 for i in range(1, n + 1)), abs=2e-11)
    total = n + 1
    tails, double = 0.0, 0.0
    for i in range(total - 2, 0, -1):
        tails += 1 / (i + 1)
        double += tails / (total - i)
    assert squares - 2 * h / total == pytest.approx(double, abs=1e-10)


def test_old_bound_of_sizes_is_no_step():
    low, high = (P.anderson_darling_normalised(3.0, 1_000_000, m) for m in (999_999, 1_000_001))
    assert low == pytest.approx(high, abs=1e-9)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    rows = [("ref", float(v)) for v in np.round(rng.lognormal(3, 2, 700), 1)]
    rows += [("cur", float(v)) for v in np.round(rng.lognormal(3.4, 2, 500), 1)]
    rows += [("ref", 5.0)] * 400  # a hot value
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_rank_statistics_against_numpy(spark, sample, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(s, "f", v) for s, v in sample], "side string, feature string, value double")
        got = D.anderson_darling(D.mann_whitney(D.rank_statistics(D.ecdf(S.value_counts_by_side(df))))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    x = np.sort([v for s, v in sample if s == "ref"])
    y = np.sort([v for s, v in sample if s == "cur"])
    grid = np.unique(np.concatenate([x, y]))
    gap = np.searchsorted(x, grid, "right") / len(x) - np.searchsorted(y, grid, "right") / len(y)
    width = np.diff(grid)
    assert got["ks"] == pytest.approx(np.abs(gap).max())
    assert got["wasserstein"] == pytest.approx((np.abs(gap[:-1]) * width).sum())
    assert got["energy"] == pytest.approx(math.sqrt(2 * (gap[:-1] ** 2 * width).sum()))
    assert got["mwu"] == pytest.approx(sum((y < v).sum() + (y == v).sum() / 2 for v in x))
    assert got["ad"] == pytest.approx(_ad_by_hand(x, y), rel=1e-9)


def test_quantiles_against_numpy(spark, sample):
    df = spark.createDataFrame([("f", v) for _, v in sample], "feature string, value double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.733, 0.95, 1.0]
    got = {r["share"]: r["quantile"] for r in S.exact_quantiles(df, shares).collect()}
    for s in shares:
        assert got[s] == pytest.approx(np.quantile([v for _, v in sample], s))


def test_quantiles_do_not_depend_on_the_limits(spark, sample):
    df = spark.createDataFrame([("f", v) for _, v in sample], "feature string, value double")
    odd = spark.createDataFrame([("f", [float(i) for i in range(33)])], "feature string, limits array<double>")
    want = S.exact_quantiles(df, [0.1, 0.9]).orderBy("share").collect()
    assert S.exact_quantiles(df, [0.1, 0.9], limits=odd).orderBy("share").collect() == want


def test_quantiles_per_group_and_weighted(spark, sample):
    df = spark.createDataFrame([("f", s, v) for s, v in sample], "feature string, side string, value double")
    got = {r["side"]: r["quantile"] for r in S.exact_quantiles(df, [0.3], ["feature", "side"]).collect()}
    for side in ("ref", "cur"):
        assert got[side] == pytest.approx(np.quantile([v for s, v in sample if s == side], 0.3))
    counts = S.value_counts_by_side(df)
    weighted = S.exact_quantiles(counts, [0.3], weight="c_ref").first()["quantile"]
    assert weighted == pytest.approx(got["ref"])


def test_a_table_does_not_drift_from_itself(spark, sample):
    rows = [v for s, v in sample if s == "ref"]
    data = [(s, v, "abc"[i % 3]) for s in ("ref", "cur") for i, v in enumerate(rows)]
    sided = spark.createDataFrame(data, "side string, x double, c string")
    methods = [m for m in D.METHODS if m not in ("anderson_darling", "mann_whitney_u", "maximum_mean_discrepancy", "adaptive_windowing")]
    for r in D.detect_drift(sided, ["x"], ["c"], methods).collect():
        assert r["statistic"] == pytest.approx(0.0, abs=1e-6), r
        assert not r["drift_detected"]


def test_missing_side_gives_no_rows(spark):
    sided = spark.createDataFrame([("ref", 1.0, 2.0), ("cur", None, 3.0)], "side string, a double, b double")
    assert {r["feature"] for r in D.detect_drift(sided, ["a", "b"], (), ["kolmogorov_smirnov"]).collect()} == {"b"}


def test_duplicate_deciles_and_empty_bins(spark):
    rows = [("ref", 1.0)] * 90 + [("ref", 9.0)] * 10 + [("cur", 9.0)] * 50
    df = spark.createDataFrame([(s, "f", v) for s, v in rows], "side string, feature string, value double")
    got = D.psi(D.decile_counts(S.as_counts(df))).first()["psi"]
    # Edges 1.0 and 1.8 (the 90% quantile): bins 90/0/10 against 0/0/50.
    p = np.array([90, 0.1, 10]) / 100
    q = np.array([0.001, 0.001, 1.0])
    p, q = np.where(p == 0.001, 0.001, p), q
    p, q = p / p.sum(), q / q.sum()
    assert got == pytest.approx(((q - p) * np.log(q / p)).sum(), rel=1e-6)


def test_custom_method_and_threshold(spark):
    D.register_method("mean_gap", lambda x: x.counts.groupBy("feature").agg(
        F.abs(F.sum(F.col("value") * F.col("c_ref")) / F.sum("c_ref") - F.sum(F.col("value") * F.col("c_cur")) / F.sum("c_cur")).alias("statistic")
    ), 0.5)
    try:
        sided = spark.createDataFrame([("ref", 1.0), ("cur", 2.0)], "side string, a double")
        row = D.detect_drift(sided, ["a"], (), ["mean_gap"]).first()
        assert (row["statistic"], row["drift_detected"]) == (1.0, True)
    finally:
        for table in (D.METHODS, D._CUSTOM, D.THRESHOLDS):
            table.pop("mean_gap")


def test_hash_cuts_give_exact_sizes(spark):
    df = spark.range(1003).withColumn("g", F.col("id") % 3)
    from tallywatch.operators import preprocess as PP

    sizes = {r["split"]: r["count"] for r in PP.train_validation_test_split(df, ["id"]).groupBy("split").count().collect()}
    assert sizes == {"train": 802, "validation": 100, "test": 101}
    by_group = PP.stratified_split(df, ["id"], "g", 0.2).where("split = 'train'").groupBy("g").count().collect()
    assert sorted(r["count"] for r in by_group) == [267, 267, 268]


def test_adaptive_windows(spark):
    rng = np.random.default_rng(3)
    rows = [("ref", float(v), "ab"[i % 2], i) for i, v in enumerate(rng.normal(0, 1, 900))]
    rows += [("cur", float(v), "abc"[i % 3], i) for i, v in enumerate(rng.normal(1, 2, 150))] + [("cur", None, None, 900)]
    sided = spark.createDataFrame(rows, "side string, x double, c string, at int").withColumnRenamed("x", "x#1")
    with pytest.raises(ValueError, match="recency"):
        D.detect_drift(sided, ["x#1"], (), ["adaptive_windowing"])
    got = {r["feature"]: r["statistic"] for r in D.detect_drift(sided, ["x#1"], ["c"], ["adaptive_windowing"], recency=["at"]).collect()}

    def js(p, q):
        p, q = np.array(p), np.array(q)
        m = (p + q) / 2
        return np.sqrt((np.sum(p[p > 0] * np.log(p[p > 0] / m[p > 0])) + np.sum(q[q > 0] * np.log(q[q > 0] / m[q > 0]))) / 2)

    x = np.array([r[1] for r in rows[:900]])
    y = np.array([r[1] for r in rows[900:1050]])[::-1]
    want = []
    for size in (50, 100):  # 150 rows fill two of the windows
        span = (min(x.min(), y[:size].min()), max(x.max(), y[:size].max()))
        want.append(js(np.histogram(x, 50, span)[0] / 900, np.histogram(y[:size], 50, span)[0] / size))
    assert got["x#1"] == pytest.approx((want[0] + want[1] / 2) / 1.5, abs=1e-4)
    c = [r[2] for r in rows[900:1050]][::-1]
    cats = [js([0.5, 0.5, 0.0], [c[:size].count(v) / size for v in "abc"]) for size in (50, 100)]
    assert got["c"] == pytest.approx((cats[0] + cats[1] / 2) / 1.5, abs=1e-4)


def test_duplicates_are_told_by_whole_rows(spark, monkeypatch):
    from tallywatch.operators import setops

    rows = [(None, "a", 1.0)] * 3 + [(1, "a", float("nan")), (1, "a", float("nan")), (1, None, 0.0), (1, None, -0.0), (2, "", 1.0), (2, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    assert tuple(setops.duplicate_count(df).first()) == (9, 5, 4)
    assert tuple(setops.duplicate_count(df.limit(0)).first()) == (0, 0, 0)
    # With one hash for all rows, full rows still decide.
    monkeypatch.setattr(setops.F, "xxhash64", lambda *c: setops.F.lit(7).cast("long"))
    assert tuple(setops.duplicate_count(df).first()) == (9, 5, 4)
