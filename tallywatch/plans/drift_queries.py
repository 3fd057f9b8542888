"""Drift queries on line items joined to orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywatch.functions import pvalues
from tallywatch.operators import drift as D
from tallywatch.operators import summaries as S
from tallywatch.session import materialise
from tallywatch.plans.bindings import CATEGORICAL, NUMERIC, SIDED_SQL, query, read, rounded, sided_lineitem

# ------------------------------------------------------------------ SQL twins

HIST_SQL = """
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM num GROUP BY feature),
binned AS (SELECT n.side, n.feature, CAST(least(floor((value - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS bucket
           FROM num n JOIN rng r ON n.feature = r.feature),
cnt AS (SELECT feature, bucket, count(*) FILTER (side = 'ref') AS c_ref, count(*) FILTER (side = 'cur') AS c_cur
        FROM binned GROUP BY ALL),
hist AS (SELECT t.feature, g.bucket, coalesce(c_ref, 0) AS c_ref, coalesce(c_cur, 0) AS c_cur, n_ref, n_cur
         FROM totals t CROSS JOIN (SELECT unnest(range(0, 50))::INTEGER AS bucket) g
         LEFT JOIN cnt c ON c.feature = t.feature AND c.bucket = g.bucket
         WHERE t.feature IN (SELECT feature FROM rng))
"""
CAT_SQL = """
catcnt AS (SELECT c.feature, value AS bucket, count(*) FILTER (side = 'ref') AS c_ref, count(*) FILTER (side = 'cur') AS c_cur,
                  max(n_ref) AS n_ref, max(n_cur) AS n_cur
           FROM cat c JOIN totals t ON c.feature = t.feature GROUP BY c.feature, value)
"""
SHARES_SQL = """
raw AS (SELECT feature, c_ref / n_ref::DOUBLE + 1e-10 AS p, c_cur / n_cur::DOUBLE + 1e-10 AS q FROM hist
        UNION ALL
        SELECT feature, CASE WHEN c_ref = 0 THEN 1e-10 ELSE c_ref / n_ref::DOUBLE END,
               CASE WHEN c_cur = 0 THEN 1e-10 ELSE c_cur / n_cur::DOUBLE END FROM catcnt),
sh AS (SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM raw)
"""
JS_EXPR = "sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2)"
DECILE_SQL = """
qs AS (SELECT feature, unnest(list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS e
       FROM num WHERE side = 'ref' GROUP BY feature),
edges AS (SELECT feature, list_sort(list(DISTINCT e)) AS edges FROM qs GROUP BY feature),
dbin AS (SELECT n.side, n.feature, len(list_filter(edges, lambda x: n.value > x)) AS bucket FROM num n JOIN edges e ON n.feature = e.feature),
dcnt AS (SELECT feature, bucket, count(*) FILTER (side = 'ref') AS c_ref, count(*) FILTER (side = 'cur') AS c_cur FROM dbin GROUP BY ALL),
dgrid AS (SELECT feature, unnest(range(0, len(edges) + 1)) AS bucket FROM edges),
stable AS (SELECT g.feature, g.bucket::VARCHAR AS bucket, coalesce(c_ref, 0) AS c_ref, coalesce(c_cur, 0) AS c_cur, n_ref, n_cur
           FROM dgrid g JOIN totals t ON g.feature = t.feature LEFT JOIN dcnt d ON d.feature = g.feature AND d.bucket = g.bucket
           UNION ALL SELECT feature, bucket, c_ref, c_cur, n_ref, n_cur FROM catcnt),
psiraw AS (SELECT feature, CASE WHEN c_ref = 0 THEN 0.001 ELSE c_ref / n_ref::DOUBLE END AS p,
                  CASE WHEN c_cur = 0 THEN 0.001 ELSE c_cur / n_cur::DOUBLE END AS q FROM stable),
psish AS (SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM psiraw),
psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS statistic FROM psish GROUP BY feature)
"""
ECDF_SQL = """
codes AS (SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY value) - 1)::DOUBLE AS code
          FROM (SELECT DISTINCT feature, value FROM cat)),
vals AS (SELECT side, feature, value FROM num
         UNION ALL SELECT c.side, c.feature, k.code FROM cat c JOIN codes k ON c.feature = k.feature AND c.value = k.value),
v AS (SELECT feature, value, count(*) FILTER (side = 'ref') AS c_ref, count(*) FILTER (side = 'cur') AS c_cur FROM vals GROUP BY ALL),
e AS (SELECT v.feature, value, c_ref, c_cur, n_ref, n_cur,
             sum(c_ref) OVER w AS u_ref, sum(c_cur) OVER w AS u_cur, lead(value) OVER w - value AS width
      FROM v JOIN totals t ON v.feature = t.feature
      WINDOW w AS (PARTITION BY v.feature ORDER BY value)),
gaps AS (SELECT *, u_ref / n_ref::DOUBLE - u_cur / n_cur::DOUBLE AS gap FROM e),
rs AS (SELECT feature, max(n_ref) AS n_ref, max(n_cur) AS n_cur, max(abs(gap)) AS ks, sum(abs(gap) * coalesce(width, 0)) AS wasserstein,
              sqrt(2 * sum(gap * gap * coalesce(width, 0))) AS energy,
              sum((u_ref - c_ref + u_cur - c_cur + (c_ref + c_cur + 1) / 2.0::DOUBLE) * c_ref) AS rank_sum,
              sum((c_ref + c_cur)::DOUBLE ** 3 - (c_ref + c_cur)) AS tie_sum
       FROM gaps GROUP BY feature)
"""
KS_P = """CASE WHEN ks * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) < 0.2 THEN 1.0 ELSE
  greatest(0.0, least(1.0, list_sum([CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END::DOUBLE
    * exp(-2.0::DOUBLE * k * k * ks * ks * n_ref * n_cur / (n_ref + n_cur)) FOR k IN range(1, 101)]))) END"""


def _sql(*ctes: str, body: str) -> str:
    return "WITH " + ",".join([SIDED_SQL, *ctes]) + body


def _both(spark, sf_dir):
    sided = sided_lineitem(spark, sf_dir)
    num = S.as_counts(S.long_numeric(sided, NUMERIC))
    cat = S.value_counts_by_side(S.long_categorical(sided, CATEGORICAL))
    return num, cat


def _counted(spark, sf_dir):
    """The same as value counts written once: for methods that pass over the data several times."""
    return D.column_counts(sided_lineitem(spark, sf_dir), NUMERIC, CATEGORICAL)


def _named(df, method, column):
    return df.select("feature", F.lit(method).alias("method"), F.col(column).alias("statistic"))


def _from_counts(method, column):
    def run(spark, sf_dir):
        num, cat = _both(spark, sf_dir)
        both = D.distances(D.histogram(num)).unionByName(D.distances(D.category_counts(cat), True))
        return rounded(_named(both, method, column))

    return run


def _result_sql(name: str, expr: str) -> str:
    return f" SELECT feature, '{name}' AS method, round({expr}, 6) AS statistic FROM sh GROUP BY feature"


query("drf_jensen_shannon", _sql(HIST_SQL, CAT_SQL, SHARES_SQL, body=_result_sql("jensen_shannon_divergence", JS_EXPR)))(
    _from_counts("jensen_shannon_divergence", "jensen_shannon")
)
query("drf_kl_divergence", _sql(HIST_SQL, CAT_SQL, SHARES_SQL, body=_result_sql("kl_divergence", "sum(q * ln(q / p))")))(
    _from_counts("kl_divergence", "kl")
)
query(
    "drf_hellinger",
    _sql(HIST_SQL, CAT_SQL, body=""" SELECT feature, 'hellinger_distance' AS method,
      round(sqrt(0.5 * sum((sqrt(c_ref / n_ref::DOUBLE) - sqrt(c_cur / n_cur::DOUBLE)) ** 2)), 6) AS statistic
      FROM (SELECT feature, c_ref, c_cur, n_ref, n_cur FROM hist UNION ALL SELECT feature, c_ref, c_cur, n_ref, n_cur FROM catcnt)
      GROUP BY feature"""),
)(_from_counts("hellinger_distance", "hellinger"))


@query(
    "drf_histogram",
    _sql(HIST_SQL, body=""" SELECT feature, bucket, c_ref::BIGINT AS c_ref, c_cur::BIGINT AS c_cur,
      n_ref::BIGINT AS n_ref, n_cur::BIGINT AS n_cur FROM hist"""),
)
def _histogram(spark, sf_dir):
    num, _ = _both(spark, sf_dir)
    return D.histogram(num).select("feature", "bucket", "c_ref", "c_cur", "n_ref", "n_cur")


@query(
    "joi_align_distributions",
    _sql(CAT_SQL, body=""" SELECT feature, bucket AS category,
      round(CASE WHEN c_ref = 0 THEN 1e-10 ELSE c_ref / n_ref::DOUBLE END, 6) AS share_ref,
      round(CASE WHEN c_cur = 0 THEN 1e-10 ELSE c_cur / n_cur::DOUBLE END, 6) AS share_cur FROM catcnt"""),
)
def _align(spark, sf_dir):
    _, cat = _both(spark, sf_dir)
    return rounded(D.align_distributions(cat, 1e-10))


@query("drf_psi", _sql(CAT_SQL, DECILE_SQL, body=""" SELECT feature, 'population_stability_index' AS method,
   round(statistic, 6) AS statistic FROM psi"""))
def _psi(spark, sf_dir):
    num, cat = _counted(spark, sf_dir)
    both = D.psi(D.decile_counts(num)).unionByName(D.psi(D.category_counts(cat)))
    return rounded(_named(both, "population_stability_index", "psi"))


@query(
    "drf_psi_equal_width",
    _sql(
        """
rr AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM num WHERE side = 'ref' GROUP BY feature),
b AS (SELECT n.side, n.feature, CAST(least(floor((value - lo) / ((hi - lo) / 10.0::DOUBLE)), 9) AS INTEGER) AS bucket
      FROM num n JOIN rr ON n.feature = rr.feature WHERE value BETWEEN lo AND hi),
c AS (SELECT feature, bucket, count(*) FILTER (side = 'ref') AS c_ref, count(*) FILTER (side = 'cur') AS c_cur FROM b GROUP BY ALL),
s AS (SELECT feature, sum(c_ref) AS n_ref, sum(c_cur) AS n_cur FROM c GROUP BY feature),
f AS (SELECT s.feature, CASE WHEN coalesce(c_ref, 0) = 0 THEN 1e-10 ELSE c_ref / n_ref::DOUBLE END AS p,
             CASE WHEN coalesce(c_cur, 0) = 0 THEN 1e-10 ELSE c_cur / n_cur::DOUBLE END AS q
      FROM s CROSS JOIN (SELECT unnest(range(0, 10))::INTEGER AS bucket) g LEFT JOIN c ON c.feature = s.feature AND c.bucket = g.bucket)
""",
        body=""" SELECT feature, 'population_stability_index_equal_width' AS method,
          round(sum((q - p) * ln(q / p)), 6) AS statistic FROM f GROUP BY feature""",
    ),
)
def _psi_equal_width(spark, sf_dir):
    num, _ = _both(spark, sf_dir)
    return rounded(_named(D.psi_equal_width(num), "population_stability_index_equal_width", "psi_equal_width"))


CSI_CTE = """
shift AS (SELECT feature, avg(value) FILTER (side = 'ref') AS a, avg(value) FILTER (side = 'cur') AS b FROM num GROUP BY feature
          UNION ALL SELECT feature, count(DISTINCT value) FILTER (side = 'ref'), count(DISTINCT value) FILTER (side = 'cur') FROM cat GROUP BY feature),
csi AS (SELECT p.feature, statistic + 0.1::DOUBLE * CASE WHEN a = 0 THEN 0 ELSE abs(b - a) / abs(a) END AS statistic
        FROM psi p JOIN shift s ON p.feature = s.feature)
"""


@query("drf_csi", _sql(CAT_SQL, DECILE_SQL, CSI_CTE, body=""" SELECT feature, 'characteristic_stability_index' AS method,
   round(statistic, 6) AS statistic FROM csi"""))
def _csi(spark, sf_dir):
    num, cat = _counted(spark, sf_dir)
    numeric = D.csi(D.psi(D.decile_counts(num)), D.relative_shift(num))
    both = numeric.unionByName(D.csi(D.psi(D.category_counts(cat)), D.relative_shift(cat, categorical=True)))
    return rounded(_named(both, "characteristic_stability_index", "csi"))


def _rank_rows(spark, sf_dir):
    num, cat = _counted(spark, sf_dir)
    return D.rank_statistics(D.ecdf(num)).unionByName(D.rank_statistics(D.ecdf(D.coded_categories(cat))))


def _numeric_ranks(spark, sf_dir):
    num, _ = D.column_counts(sided_lineitem(spark, sf_dir), NUMERIC, ())
    return D.rank_statistics(D.ecdf(num))


@query("drf_ks", _sql(ECDF_SQL, body=f""" SELECT feature, 'kolmogorov_smirnov' AS method, round(ks, 6) AS statistic,
   round({KS_P}, 6) AS p_value FROM rs"""))
def _ks(spark, sf_dir):
    rows = D.kolmogorov_smirnov(_rank_rows(spark, sf_dir)).withColumnRenamed("ks_p", "p_value")
    return rounded(rows.select("feature", F.lit("kolmogorov_smirnov").alias("method"), F.col("ks").alias("statistic"), "p_value"))


@query("drf_wasserstein", _sql(ECDF_SQL, body=""" SELECT feature, m AS method, round(wasserstein, 4) AS statistic
   FROM rs, (VALUES ('wasserstein'), ('earth_movers_distance')) t(m) WHERE feature LIKE 'l_%' AND feature <> 'l_returnflag'"""))
def _wasserstein(spark, sf_dir):
    names = F.explode(F.array(F.lit("wasserstein"), F.lit("earth_movers_distance"))).alias("method")
    return rounded(_numeric_ranks(spark, sf_dir).select("feature", names, F.col("wasserstein").alias("statistic")), 4)


@query("drf_energy_distance", _sql(ECDF_SQL, body=""" SELECT feature, 'energy_distance' AS method, round(energy, 4) AS statistic FROM rs"""))
def _energy(spark, sf_dir):
    return rounded(_named(_rank_rows(spark, sf_dir), "energy_distance", "energy"), 4)


@query("drf_mann_whitney", _sql(ECDF_SQL, body=""" , u AS (SELECT feature, n_ref::DOUBLE AS n, n_cur::DOUBLE AS m, tie_sum,
     rank_sum - n_ref::DOUBLE * (n_ref + 1) / 2 AS u FROM rs)
   SELECT feature, 'mann_whitney_u' AS method, round(u, 1) AS statistic,
     round((greatest(u, n * m - u) - n * m / 2 - 0.5) / sqrt(n * m / 12 * ((n + m + 1) - tie_sum / ((n + m) * (n + m - 1)))), 4) AS z
   FROM u WHERE feature LIKE 'l_%' AND feature <> 'l_returnflag'"""))
def _mann_whitney(spark, sf_dir):
    rows = D.mann_whitney(_numeric_ranks(spark, sf_dir))
    return rounded(
        rows.select("feature", F.lit("mann_whitney_u").alias("method"), F.col("mwu").alias("statistic"), F.col("mwu_z").alias("z")),
        4,
        statistic=1,
    )


AD_CTE = """
adv AS (SELECT feature, value, c_ref::DOUBLE AS c_ref, c_cur::DOUBLE AS c_cur, n_ref::DOUBLE AS n_ref, n_cur::DOUBLE AS n_cur,
               u_ref - c_ref + u_cur - c_cur + (c_ref + c_cur) / 2.0::DOUBLE AS b, u_ref - c_ref / 2.0::DOUBLE AS m_ref,
               u_cur - c_cur / 2.0::DOUBLE AS m_cur, (n_ref + n_cur)::DOUBLE AS n, (c_ref + c_cur)::DOUBLE AS l FROM e),
ad AS (SELECT feature, (max(n) - 1) / max(n) * (
         sum(CASE WHEN b * (n - b) - n * l / 4 = 0 THEN 0 ELSE l / n * (n * m_ref - b * n_ref) ** 2 / (b * (n - b) - n * l / 4) END / n_ref)
       + sum(CASE WHEN b * (n - b) - n * l / 4 = 0 THEN 0 ELSE l / n * (n * m_cur - b * n_cur) ** 2 / (b * (n - b) - n * l / 4) END / n_cur)) AS a2
       FROM adv GROUP BY feature)
"""


@query("drf_anderson_darling_sum", _sql(ECDF_SQL, AD_CTE, body=""" SELECT feature, round(a2, 4) AS ad FROM ad"""))
def _ad_sum(spark, sf_dir):
    return rounded(_rank_rows(spark, sf_dir).select("feature", "ad"), 4)


def _ad_sql() -> str:
    """The variance by sums written out term by term, and p by the quadratic through the published critical values."""
    import numpy as np

    critical = [sum(c) for c in zip(pvalues.AD_B0, pvalues.AD_B1, pvalues.AD_B2)]
    c0, c1, c2 = np.linalg.lstsq(np.vander(critical, 3, increasing=True), np.log(pvalues.AD_SIGNIFICANCE), rcond=None)[0]
    return f"""
nm AS (SELECT ad.feature, a2, n_ref::DOUBLE AS n, n_cur::DOUBLE AS m, (n_ref + n_cur)::BIGINT AS t FROM ad JOIN totals ON totals.feature = ad.feature WHERE ad.feature IN ({', '.join(repr(c) for c in NUMERIC)})),
ix AS (SELECT DISTINCT t FROM nm), js AS (SELECT t, unnest(range(1, t)) AS j FROM ix),
tl AS (SELECT t, j, sum(1.0::DOUBLE / j) OVER (PARTITION BY t ORDER BY j DESC ROWS UNBOUNDED PRECEDING) - 1.0::DOUBLE / j AS above FROM js),
hg AS (SELECT t, sum(1.0::DOUBLE / j) AS h, sum(above / (t - j)) AS g FROM tl GROUP BY t),
cf AS (SELECT feature, a2, nm.t::DOUBLE AS t, h, g, (4 * g - 6) + (10 - 6 * g) * (1 / n + 1 / m) AS a, (2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * (1 / n + 1 / m) - 8 * h + 4 * g - 6 AS b,
         (6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * (1 / n + 1 / m) + 4 * h AS c, (2 * h + 6) * 4 - 16 * h AS d FROM nm JOIN hg ON hg.t = nm.t),
st AS (SELECT feature, (a2 - 1) / sqrt((a * t ** 3 + b * t ** 2 + c * t + d) / ((t - 1) * (t - 2) * (t - 3))) AS s FROM cf),
pv AS (SELECT feature, s, CASE WHEN s < {min(critical)!r} THEN 0.25 WHEN s > {max(critical)!r} THEN 0.001 ELSE least(greatest(exp({float(c0)!r}::DOUBLE + {float(c1)!r}::DOUBLE * s + {float(c2)!r}::DOUBLE * s * s), 0.001), 0.25) END AS p FROM st)
"""


@query("drf_anderson_darling", _sql(ECDF_SQL, AD_CTE, _ad_sql(), body=""" SELECT feature, round(s, 4) AS statistic, round(p, 6)::DOUBLE AS p_value FROM pv"""))
def _anderson_darling(spark, sf_dir):
    rows = D.anderson_darling(_numeric_ranks(spark, sf_dir))
    return rounded(rows.select("feature", F.col("ad_statistic").alias("statistic"), F.col("ad_p").alias("p_value")), 6, statistic=4)


@query(
    "drf_chi_square",
    _sql(
        CAT_SQL,
        """
k AS (SELECT feature, count(*) AS k FROM catcnt GROUP BY feature),
ex AS (SELECT c.feature, k, c_ref::DOUBLE AS c_ref, c_cur::DOUBLE AS c_cur,
              (c_ref + c_cur)::DOUBLE * n_ref / (n_ref + n_cur) AS e_ref, (c_ref + c_cur)::DOUBLE * n_cur / (n_ref + n_cur) AS e_cur
       FROM catcnt c JOIN k ON c.feature = k.feature),
x AS (SELECT feature, max(k)::INTEGER - 1 AS dof, sum((c_ref - e_ref) ** 2 / e_ref + (c_cur - e_cur) ** 2 / e_cur) AS x FROM ex GROUP BY feature)
""",
        body=""" SELECT feature, 'chi_square' AS method, round(x, 6) AS statistic, dof,
          round(CASE dof WHEN 2 THEN exp(-x / 2) WHEN 4 THEN exp(-x / 2) * (1 + x / 2) END, 6) AS p_value FROM x""",
    ),
)
def _chi_square(spark, sf_dir):
    _, cat = _both(spark, sf_dir)
    rows = D.chi_square(D.category_counts(cat))
    return rounded(
        rows.select(
            "feature", F.lit("chi_square").alias("method"), F.col("chi_square").alias("statistic"), "dof", F.col("chi_square_p").alias("p_value")
        )
    )


# All rows: values are rounded to the first, counted, and only values within reach of the kernel meet.
MMD_CTE = """
vc AS (SELECT side, feature, value, count(*)::DOUBLE AS n FROM num GROUP BY ALL),
sz AS (SELECT feature, sum(n) FILTER (side = 'ref') AS nr, sum(n) FILTER (side = 'cur') AS nc FROM vc GROUP BY feature),
bins AS (SELECT *, floor(value / 7.0) AS b FROM vc),
near AS (SELECT side, feature, value, n, b + d AS b FROM bins, (SELECT unnest([-1, 0, 1]) AS d)),
kern AS (SELECT x.feature, x.side AS s1, y.side AS s2, sum(x.n * y.n * exp(-((x.value - y.value) ** 2))) AS k
         FROM bins x JOIN near y ON x.feature = y.feature AND x.b = y.b GROUP BY ALL)
"""


@query(
    "drf_mmd",
    _sql(
        MMD_CTE,
        body=""" SELECT feature, 'maximum_mean_discrepancy' AS method,
          round(sum(CASE WHEN s1 <> s2 THEN -k / (nr * nc) WHEN s1 = 'ref' THEN k / (nr * nr) ELSE k / (nc * nc) END), 6) + 0.0 AS statistic
          FROM kern JOIN sz USING (feature) GROUP BY feature""",
    ),
)
def _mmd(spark, sf_dir):
    long_df = S.long_numeric(sided_lineitem(spark, sf_dir), list(NUMERIC))
    return rounded(_named(D.mmd(long_df), "maximum_mean_discrepancy", "mmd"))


@query(
    "drf_mmd_categorical",
    _sql(
        """
sh AS (SELECT feature, value, count(*) FILTER (side = 'ref')::DOUBLE AS r, count(*) FILTER (side = 'cur')::DOUBLE AS c FROM cat GROUP BY ALL)
""",
        body=""" SELECT feature, 'maximum_mean_discrepancy' AS method,
          round((1 - exp(-2.0::DOUBLE)) * sum((r / n_ref - c / n_cur) ** 2), 6) AS statistic FROM sh JOIN totals USING (feature) GROUP BY feature""",
    ),
)
def _mmd_categorical(spark, sf_dir):
    _, counts = _both(spark, sf_dir)
    return rounded(_named(D.mmd_categorical(counts), "maximum_mean_discrepancy", "mmd"))


# ------------------------------------------------------------------ reports

SQL_METHODS = (
    "kolmogorov_smirnov",
    "jensen_shannon_divergence",
    "kl_divergence",
    "hellinger_distance",
    "population_stability_index",
    "characteristic_stability_index",
    "wasserstein",
    "energy_distance",
)
REPORT_SQL = f"""
allm AS (
  SELECT feature, 'kolmogorov_smirnov' AS method, ks AS statistic, {KS_P} AS p_value FROM rs
  UNION ALL SELECT feature, 'jensen_shannon_divergence', {JS_EXPR}, NULL FROM sh GROUP BY feature
  UNION ALL SELECT feature, 'kl_divergence', sum(q * ln(q / p)), NULL FROM sh GROUP BY feature
  UNION ALL SELECT feature, 'hellinger_distance', sqrt(0.5 * sum((sqrt(c_ref / n_ref::DOUBLE) - sqrt(c_cur / n_cur::DOUBLE)) ** 2)), NULL
    FROM (SELECT feature, c_ref, c_cur, n_ref, n_cur FROM hist UNION ALL SELECT feature, c_ref, c_cur, n_ref, n_cur FROM catcnt) GROUP BY feature
  UNION ALL SELECT feature, 'population_stability_index', statistic, NULL FROM psi
  UNION ALL SELECT feature, 'characteristic_stability_index', statistic, NULL FROM csi
  UNION ALL SELECT feature, 'wasserstein', wasserstein, NULL FROM rs WHERE feature IN (SELECT feature FROM num)
  UNION ALL SELECT feature, 'energy_distance', energy, NULL FROM rs),
report AS (SELECT feature, feature IN (SELECT feature FROM cat) AS is_categorical, method, statistic, p_value,
    CASE WHEN p_value IS NOT NULL THEN 1 - p_value
         ELSE least(1.0, statistic / CASE method WHEN 'population_stability_index' THEN 0.5 WHEN 'kl_divergence' THEN 2.0 ELSE 1.0 END) END AS score,
    CASE WHEN method = 'kolmogorov_smirnov' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS threshold,
    CASE WHEN p_value IS NOT NULL THEN p_value < 0.05 ELSE statistic > 0.1 END AS drift_detected FROM allm),
feat AS (SELECT feature, is_categorical, avg(score) AS drift_score, bool_or(drift_detected) AS drift_detected,
                coalesce(list_sort(list(method) FILTER (drift_detected)), []) AS methods_triggered
         FROM report GROUP BY feature, is_categorical)
"""
REPORT_CTES = (HIST_SQL, CAT_SQL, SHARES_SQL, DECILE_SQL, CSI_CTE, ECDF_SQL, REPORT_SQL)


def report(spark, sf_dir, methods=SQL_METHODS):
    return D.detect_drift(sided_lineitem(spark, sf_dir), NUMERIC, CATEGORICAL, methods)


def saved_report(spark, sf_dir, methods=SQL_METHODS):
    """The report's few rows, computed once for the queries that read them several times."""
    return materialise(report(spark, sf_dir, methods))


@query(
    "drf_detect_drift",
    _sql(*REPORT_CTES, body=""" SELECT feature, is_categorical, method, round(statistic, 4) AS statistic, round(p_value, 6) AS p_value,
      round(score, 6) AS score, threshold, drift_detected FROM report"""),
)
def _detect(spark, sf_dir):
    return rounded(report(spark, sf_dir), statistic=4)


@query("drf_detect_drift_all_methods")
def _detect_all(spark, sf_dir):
    return rounded(D.detect_drift(sided_lineitem(spark, sf_dir), NUMERIC, CATEGORICAL), 4)


@query(
    "drf_evaluate_threshold",
    _sql(*REPORT_CTES, body=""" SELECT feature, method, drift_detected FROM (
       SELECT feature, method, CASE WHEN p_value IS NOT NULL THEN p_value < 0.01 ELSE statistic > CASE method WHEN 'hellinger_distance' THEN 0.02 ELSE 0.1 END END AS drift_detected
       FROM report WHERE method IN ('kolmogorov_smirnov', 'hellinger_distance', 'jensen_shannon_divergence'))"""),
)
def _thresholds(spark, sf_dir):
    return D.detect_drift(
        sided_lineitem(spark, sf_dir),
        NUMERIC,
        CATEGORICAL,
        ["kolmogorov_smirnov", "hellinger_distance", "jensen_shannon_divergence"],
        {"kolmogorov_smirnov": 0.01, "hellinger_distance": 0.02},
    ).select("feature", "method", "drift_detected")


@query("drf_feature_scores", _sql(*REPORT_CTES, body=""" SELECT feature, is_categorical, round(drift_score, 6) AS drift_score, drift_detected,
   array_to_string(methods_triggered, ',') AS methods_triggered FROM feat"""))
def _feature_scores(spark, sf_dir):
    rows = D.feature_scores(report(spark, sf_dir))
    return rounded(rows.withColumn("methods_triggered", F.concat_ws(",", "methods_triggered")))


@query("drf_overall_drift", _sql(*REPORT_CTES, body=""" SELECT round(avg(drift_score), 6) AS overall_drift_score, count(*) AS features_analyzed,
   count(*) FILTER (drift_detected) AS features_with_drift, avg(drift_score) > 0.1 AS overall_drift_detected FROM feat"""))
def _overall(spark, sf_dir):
    return rounded(D.overall_drift(report(spark, sf_dir)))


@query("drf_method_summary", _sql(*REPORT_CTES, body=""" SELECT method, round(avg(score), 6) AS average_score, round(max(score), 6) AS max_score,
   count(*) FILTER (score > 0.1) AS features_with_drift, count(*) FILTER (drift_detected) AS features_flagged, count(*) AS total_features
   FROM report GROUP BY method"""))
def _method_summary(spark, sf_dir):
    return rounded(D.method_summary(report(spark, sf_dir)))


ENSEMBLE = ("jensen_shannon_divergence", "population_stability_index", "kolmogorov_smirnov", "wasserstein")


@query("drf_ensemble", _sql(*REPORT_CTES, body=f""" SELECT feature, 'drift_ensemble' AS method, round(avg(score), 6) AS statistic,
   round(stddev_pop(score), 6) AS spread, count(*) AS members FROM report WHERE method IN {ENSEMBLE} GROUP BY feature"""))
def _ensemble(spark, sf_dir):
    rows = D.ensemble(report(spark, sf_dir, ENSEMBLE), ENSEMBLE)
    return rounded(rows.withColumn("method", F.lit("drift_ensemble")))


QUALITY_CTE = """
cells AS (SELECT side, feature, value::VARCHAR AS value, value = 0 AS z FROM (
   SELECT side, 'l_quantity' AS feature, CASE WHEN side = 'cur' AND l_quantity % 7 = 0 THEN NULL ELSE l_quantity END AS value FROM base
   UNION ALL SELECT side, 'l_discount', l_discount FROM base)
   UNION ALL SELECT side, 'o_orderstatus', o_orderstatus, false FROM base),
fq AS (SELECT side, feature, count(*) AS rows, count(*) FILTER (value IS NULL) / count(*)::DOUBLE AS missing_rate, count(DISTINCT value) AS distinct_values,
              count(*) FILTER (z) / count(*)::DOUBLE AS zero_rate FROM cells GROUP BY ALL)
"""


def _with_gaps(spark, sf_dir):
    """Current quantities that are multiples of seven are missing."""
    return sided_lineitem(spark, sf_dir).withColumn(
        "l_quantity", F.when((F.col("side") == "ref") | (F.col("l_quantity") % 7 != 0), F.col("l_quantity"))
    )


def _quality(spark, sf_dir):
    return D.feature_quality(_with_gaps(spark, sf_dir), ["l_quantity", "l_discount", "o_orderstatus"])


@query("drf_feature_quality", _sql(QUALITY_CTE, body=""" SELECT side, feature, rows, round(missing_rate, 6) AS missing_rate, distinct_values,
   round(zero_rate, 6) AS zero_rate FROM fq"""))
def _feature_quality(spark, sf_dir):
    return rounded(_quality(spark, sf_dir))


PORTFOLIO_CTE = """
pf AS (SELECT f.feature, f.drift_detected, f.drift_score, q.rr, q.rc, q.mc FROM feat f LEFT JOIN (
         SELECT feature, max(rows) FILTER (side = 'ref') AS rr, max(rows) FILTER (side = 'cur') AS rc,
                max(missing_rate) FILTER (side = 'cur') - max(missing_rate) FILTER (side = 'ref') AS mc FROM fq GROUP BY feature) q
       ON f.feature = q.feature),
port AS (SELECT max(rr) AS reference_size, max(rc) AS current_size, count(*) AS total_features,
   count(*) FILTER (drift_detected) AS features_with_drift, avg(mc) AS avg_missing_rate_change,
   count(*) FILTER (mc > 0.05) AS features_with_quality_degradation,
   count(*) FILTER (drift_detected AND drift_score > 0.5) AS high_impact_features,
   count(*) FILTER (drift_detected AND drift_score > 0.7) AS critical_drift_count,
   max(rc) / max(rr)::DOUBLE AS size_ratio, abs(max(rc) / max(rr)::DOUBLE - 1) > 0.2 AS volume_drift_detected,
   count(*) FILTER (drift_detected) / count(*)::DOUBLE * 100 AS drift_percentage FROM pf)
"""


@query("drf_portfolio_metrics", _sql(*REPORT_CTES, QUALITY_CTE, PORTFOLIO_CTE, body=""" SELECT * REPLACE (
   round(avg_missing_rate_change, 6) AS avg_missing_rate_change, round(size_ratio, 6) AS size_ratio, round(drift_percentage, 6) AS drift_percentage) FROM port"""))
def _portfolio(spark, sf_dir):
    return rounded(D.portfolio_metrics(report(spark, sf_dir), _quality(spark, sf_dir)))


@query("drf_recommendations", _sql(*REPORT_CTES, QUALITY_CTE, PORTFOLIO_CTE, body="""
   , o AS (SELECT avg(drift_score) AS s FROM feat)
   SELECT 'critical' AS priority, 'model_intervention' AS category, 'retrain' AS action, NULL::VARCHAR AS feature FROM o WHERE s > 0.7
   UNION ALL SELECT 'high', 'data_collection', 'check_volume', NULL FROM port WHERE volume_drift_detected
   UNION ALL SELECT 'high', 'feature_monitoring', 'watch', feature FROM feat WHERE drift_detected AND drift_score > 0.5
   UNION ALL SELECT 'medium', 'data_quality', 'repair', NULL FROM port WHERE features_with_quality_degradation > 0
   UNION ALL SELECT 'medium', 'monitoring', 'monitor', NULL FROM o WHERE s > 0.3"""))
def _recommendations(spark, sf_dir):
    saved = saved_report(spark, sf_dir)
    portfolio = materialise(D.portfolio_metrics(saved, _quality(spark, sf_dir)))
    return D.drift_recommendations(saved, portfolio)


@query("drf_dataset_drift", _sql(ECDF_SQL, CAT_SQL, """
x AS (SELECT feature, count(*) - 1 AS dof, sum((c_ref - er) ** 2 / er + (c_cur - ec) ** 2 / ec) AS x FROM (
   SELECT *, (c_ref + c_cur)::DOUBLE * n_ref / (n_ref + n_cur) AS er, (c_ref + c_cur)::DOUBLE * n_cur / (n_ref + n_cur) AS ec FROM catcnt) GROUP BY feature)""",
   f"""flags AS (SELECT feature, {KS_P} < 0.05 AS f FROM rs WHERE feature IN (SELECT feature FROM num)
   UNION ALL SELECT feature, CASE dof WHEN 2 THEN exp(-x / 2) ELSE exp(-x / 2) * (1 + x / 2) END < 0.05 FROM x)""",
   body=""" SELECT count(*) AS columns, count(*) FILTER (f) AS drifted_columns, round(count(*) FILTER (f) / count(*)::DOUBLE, 6) AS drifted_share,
   count(*) FILTER (f) / count(*)::DOUBLE >= 0.5 AS dataset_drift FROM flags"""))
def _dataset_drift(spark, sf_dir):
    rows = D.detect_drift(sided_lineitem(spark, sf_dir), NUMERIC, CATEGORICAL, ["kolmogorov_smirnov", "chi_square"])
    return rounded(D.dataset_drift(rows))


@query("drf_prediction_change", _sql(ECDF_SQL, f"""
st AS (SELECT feature, avg(value) FILTER (side = 'ref') AS mean_ref, stddev_pop(value) FILTER (side = 'ref') AS std_ref,
   min(value) FILTER (side = 'ref') AS min_ref, max(value) FILTER (side = 'ref') AS max_ref,
   avg(value) FILTER (side = 'cur') AS mean_cur, stddev_pop(value) FILTER (side = 'cur') AS std_cur,
   min(value) FILTER (side = 'cur') AS min_cur, max(value) FILTER (side = 'cur') AS max_cur,
   quantile_cont(value, 0.5) FILTER (side = 'ref') AS median_ref, quantile_cont(value, 0.5) FILTER (side = 'cur') AS median_cur
   FROM num WHERE feature = 'l_extendedprice' GROUP BY feature),
kk AS (SELECT feature, ks AS ks_statistic, {KS_P} AS ks_p_value FROM rs)""",
   body=""" SELECT feature, round(mean_ref, 4) AS mean_ref, round(std_ref, 4) AS std_ref, round(min_ref, 4) AS min_ref, round(max_ref, 4) AS max_ref,
   round(mean_cur, 4) AS mean_cur, round(std_cur, 4) AS std_cur, round(min_cur, 4) AS min_cur, round(max_cur, 4) AS max_cur,
   round(median_ref, 4) AS median_ref, round(median_cur, 4) AS median_cur, round(ks_statistic, 4) AS ks_statistic, round(ks_p_value, 4) AS ks_p_value,
   round(mean_cur - mean_ref, 4) AS mean_shift, round(std_cur / std_ref, 4) AS std_ratio, round((mean_cur - mean_ref) / mean_ref, 4) AS relative_change,
   concat_ws(';', CASE WHEN mean_cur - mean_ref > 0.1 THEN 'mean_increased' WHEN mean_cur - mean_ref < -0.1 THEN 'mean_decreased' END,
     CASE WHEN std_cur / std_ref > 1.2 THEN 'spread_increased' WHEN std_cur / std_ref < 0.8 THEN 'spread_decreased' END,
     CASE WHEN ks_p_value < 0.05 THEN 'confirmed_by_test' END) AS interpretation
   FROM st JOIN kk USING (feature)"""))
def _prediction_change(spark, sf_dir):
    return rounded(D.prediction_change(sided_lineitem(spark, sf_dir), "l_extendedprice"), 4)


@query("drf_monitor_drift", _sql(ECDF_SQL, body=""" SELECT round(avg(ks), 6) AS drift_score, count(*) AS features, avg(ks) > 0.05 AS drift_detected
   FROM rs WHERE feature IN (SELECT feature FROM num)"""))
def _monitor(spark, sf_dir):
    rows = D.detect_drift(sided_lineitem(spark, sf_dir), NUMERIC, (), ["kolmogorov_smirnov"])
    return rounded(D.monitor_drift(rows, "kolmogorov_smirnov", 0.05))


@query("drf_performance_drift", _sql("""
mt AS (SELECT side, avg(CASE WHEN (l_discount >= 0.05) = (l_returnflag = 'R') THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy, avg(l_tax) AS mean_tax,
       avg(l_extendedprice) AS mean_price FROM base GROUP BY side),
ml AS (UNPIVOT mt ON accuracy, mean_tax, mean_price INTO NAME metric VALUE value)""",
   body=""" SELECT round(avg(abs(c.value - r.value) / abs(r.value)), 6) AS performance_drift, count(*) AS metrics,
   avg(abs(c.value - r.value) / abs(r.value)) > 0.1 AS drift_detected FROM ml r JOIN ml c ON r.metric = c.metric AND r.side = 'ref' AND c.side = 'cur'"""))
def _performance_drift(spark, sf_dir):
    metrics = (
        sided_lineitem(spark, sf_dir)
        .groupBy("side")
        .agg(
            F.avg(F.when((F.col("l_discount") >= 0.05) == (F.col("l_returnflag") == "R"), 1.0).otherwise(0.0)).alias("accuracy"),
            F.avg("l_tax").alias("mean_tax"),
            F.avg("l_extendedprice").alias("mean_price"),
        )
        .unpivot(["side"], ["accuracy", "mean_tax", "mean_price"], "metric", "value")
    )
    return rounded(D.performance_drift(metrics.where("side = 'ref'"), metrics.where("side = 'cur'")))


HISTORY_SQL = """WITH h AS (SELECT user_id % 5 AS model_id, CAST(ts AS DATE) AS d, avg(value) AS m FROM events GROUP BY ALL),
hist AS (SELECT model_id, d, abs(m - 50) / 50 AS drift_score, abs(m - 50) / 50 > 0.1 AS drift_detected FROM h)
"""


def drift_history(spark, sf_dir):
    """Daily drift score per model from the events: distance of the mean value from 50."""
    days = read(spark, sf_dir, "events").groupBy(
        (F.col("user_id") % 5).alias("model_id"), F.to_date("ts").alias("ts")
    ).agg((F.abs(F.avg("value") - 50) / 50).alias("drift_score"))
    return days.withColumn("drift_detected", F.col("drift_score") > 0.1)


@query("drf_drift_trend", HISTORY_SQL + """ SELECT model_id, CASE WHEN arg_max(drift_detected, d) THEN 'drift_detected' ELSE 'stable' END AS current_status,
   count(*) FILTER (drift_detected) AS drift_events, round(count(*) FILTER (drift_detected) / count(*)::DOUBLE, 6) AS drift_frequency,
   round(arg_max(drift_score, d), 6) AS latest_score FROM hist GROUP BY model_id""")
def _drift_trend(spark, sf_dir):
    return rounded(D.drift_trend(drift_history(spark, sf_dir)))


@query("drf_dashboard_stats", _sql(*REPORT_CTES, body="""
   SELECT (SELECT count(*) FROM events WHERE event_type <> 'click' AND value > 200) AS critical_open,
   (SELECT count(*) FROM events WHERE event_type <> 'click' AND value > 100 AND value <= 200) AS high_open,
   count(*) FILTER (drift_detected) AS drifting_features, round(avg(drift_score), 6) AS mean_score FROM feat"""))
def _dashboard(spark, sf_dir):
    alerts = read(spark, sf_dir, "events").select(
        (F.col("event_type") == "click").alias("acknowledged"),
        F.when(F.col("value") > 200, "critical").when(F.col("value") > 100, "high").otherwise("low").alias("severity"),
    )
    return rounded(D.dashboard_stats(alerts, report(spark, sf_dir)))


@query(
    "drf_adaptive_windowing",
    """WITH base AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'ref' ELSE 'cur' END AS side, value, ts, event_id FROM events),
cur AS (SELECT value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM base WHERE side = 'cur'),
w AS (SELECT * FROM (VALUES (50, 1.0), (100, 0.5), (200, 1.0 / 3), (500, 0.25)) t(size, weight) WHERE size <= (SELECT count(*) FROM cur)),
x AS (SELECT size, 'ref' AS side, value FROM base, w WHERE side = 'ref' UNION ALL SELECT size, 'cur', value FROM cur, w WHERE rn <= size),
r AS (SELECT size, min(value) AS lo, max(value) AS hi, count(*) FILTER (side = 'ref') AS n, count(*) FILTER (side = 'cur') AS m FROM x GROUP BY size),
b AS (SELECT x.size, CAST(least(floor((value - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS bucket, side FROM x JOIN r ON x.size = r.size),
c AS (SELECT size, bucket, count(*) FILTER (side = 'ref') AS a, count(*) FILTER (side = 'cur') AS z FROM b GROUP BY ALL),
s AS (SELECT r.size, coalesce(a, 0) / n::DOUBLE + 1e-10 AS p, coalesce(z, 0) / m::DOUBLE + 1e-10 AS q
      FROM r CROSS JOIN (SELECT unnest(range(0, 50))::INTEGER AS bucket) g LEFT JOIN c ON c.size = r.size AND c.bucket = g.bucket),
nn AS (SELECT size, p / sum(p) OVER (PARTITION BY size) AS p, q / sum(q) OVER (PARTITION BY size) AS q FROM s),
j AS (SELECT size, sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2) AS js FROM nn GROUP BY size),
cc AS (SELECT event_type AS v, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
cr AS (SELECT event_type AS v, count(*) AS a FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
cz AS (SELECT size, v, count(*) AS z FROM cc JOIN w ON rn <= size GROUP BY ALL),
cv AS (SELECT w.size, v FROM w, cr UNION SELECT size, v FROM cz),
cn AS (SELECT cv.size, coalesce(a, 0) AS a, coalesce(z, 0) AS z, sum(coalesce(a, 0)) OVER s AS n, sum(coalesce(z, 0)) OVER s AS m, count(*) FILTER (coalesce(a, 0) = 0) OVER s AS za, count(*) FILTER (coalesce(z, 0) = 0) OVER s AS zz
       FROM cv LEFT JOIN cr ON cr.v = cv.v LEFT JOIN cz ON cz.v = cv.v AND cz.size = cv.size WINDOW s AS (PARTITION BY cv.size)),
cp AS (SELECT size, CASE a WHEN 0 THEN 1e-10 ELSE a / n::DOUBLE END / (1 + 1e-10 * za) AS p, CASE z WHEN 0 THEN 1e-10 ELSE z / m::DOUBLE END / (1 + 1e-10 * zz) AS q FROM cn),
cj AS (SELECT size, sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2) AS js FROM cp GROUP BY size)
SELECT 'value' AS feature, 'adaptive_windowing' AS method, round(sum(js * weight) / sum(weight), 6) AS statistic FROM j JOIN w ON j.size = w.size
UNION ALL SELECT 'event_type', 'adaptive_windowing', round(sum(js * weight) / sum(weight), 6) FROM cj JOIN w ON cj.size = w.size""",
)
def _adaptive(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    sided = events.withColumn("side", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "ref").otherwise("cur"))
    rows = D.detect_drift(sided, ["value"], ["event_type"], ["adaptive_windowing"], recency=["ts", "event_id"])
    return rounded(rows.select("feature", "method", "statistic"))


@query("drf_adversarial_accuracy")
def _adversarial(spark, sf_dir):
    return rounded(D.adversarial_accuracy(sided_lineitem(spark, sf_dir), NUMERIC), 4)


@query("drf_validate_compatibility", """SELECT 'warning' AS level, 'only_in_reference' AS check, 'o_orderdate' AS detail UNION ALL SELECT 'warning', 'only_in_current', 'extra'
   UNION ALL SELECT 'warning', 'different_types', 'o_custkey: bigint vs string'
   UNION ALL SELECT 'warning', 'small_reference', count(*)::VARCHAR FROM orders HAVING count(*) < 10 UNION ALL SELECT 'warning', 'small_current', count(*)::VARCHAR FROM orders WHERE o_orderkey < 5 HAVING count(*) < 10""")
def _compatibility(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    cur = orders.where("o_orderkey < 5").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.lit(1).alias("extra"))
    return D.validate_compatibility(orders.select("o_orderkey", "o_custkey", "o_orderdate"), cur)
