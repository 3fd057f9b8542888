"""Quality and preprocessing queries on customers, parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywatch.operators import preprocess as P
from tallywatch.operators import quality as Q
from tallywatch.operators import summaries as S
from tallywatch.plans.bindings import query, read, rounded
from tallywatch.plans.table_queries import GAPPY, gappy

# Customers with gaps plus a second copy of some rows.
DIRTY = f"""dirty AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM {GAPPY} g
   UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM {GAPPY} g WHERE c_custkey % 13 = 0)"""


def dirty(spark, sf_dir):
    rows = gappy(spark, sf_dir)
    return rows.unionByName(rows.where("c_custkey % 13 = 0"))


@query("qua_missing_counts", f"""WITH {DIRTY} SELECT * FROM (
   SELECT 'c_custkey' AS column, count(*) AS rows, count(*) - count(c_custkey) AS missing FROM dirty UNION ALL
   SELECT 'c_acctbal', count(*), count(*) - count(c_acctbal) FROM dirty UNION ALL
   SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment) FROM dirty UNION ALL
   SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey) FROM dirty)""")
def _missing(spark, sf_dir):
    return Q.missing_counts(dirty(spark, sf_dir))


@query("qua_duplicate_rows", f"""WITH {DIRTY} SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows,
   count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows FROM dirty""")
def _duplicates(spark, sf_dir):
    from tallywatch.operators.setops import duplicate_count

    return duplicate_count(dirty(spark, sf_dir))


def _fence_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS feature, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high,
      count({column}) AS values, count(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM {source}, (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source}) GROUP BY q1, q3"""


@query("qua_outliers_iqr", _fence_sql("value", "events") + " UNION ALL " + _fence_sql("user_id", "events"))
def _outliers(spark, sf_dir):
    return rounded(Q.outlier_counts(read(spark, sf_dir, "events"), ["value", "user_id"]), 4)


@query("qua_assess_quality", f"""WITH {DIRTY}, f AS (
   SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows,
     4 * count(*) - count(c_custkey) - count(c_acctbal) - count(c_mktsegment) - count(c_nationkey) AS missing_values, 2 AS columns_with_missing FROM dirty),
   o AS (SELECT sum(outliers)::BIGINT AS outliers FROM ({_fence_sql("c_custkey", "dirty")} UNION ALL {_fence_sql("c_acctbal", "dirty")} UNION ALL {_fence_sql("c_nationkey", "dirty")})),
   s AS (SELECT *, greatest(0, least(1, 0.4 * (1 - missing_values / (rows * 4)::DOUBLE) + 0.3 * (1 - duplicate_rows / rows::DOUBLE) + 0.3 * (1 - outliers / rows::DOUBLE))) AS q FROM f, o)
   SELECT rows, duplicate_rows, missing_values, columns_with_missing::BIGINT AS columns_with_missing, outliers, round(q, 6) AS quality_score,
   concat_ws(';', 'missing values in 2 columns', CASE WHEN duplicate_rows > 0 THEN duplicate_rows || ' duplicate rows' END,
     CASE WHEN outliers > rows * 0.1 THEN 'high number of outliers' END) AS issues, q < 0.7 AS alert FROM s""")
def _assess(spark, sf_dir):
    return rounded(Q.assess_quality(dirty(spark, sf_dir)))


@query("qua_compute_statistics_numeric", f"""WITH {DIRTY} SELECT 'c_acctbal' AS feature, count(c_acctbal) AS count, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std,
   min(c_acctbal) AS min, max(c_acctbal) AS max, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50,
   round(quantile_cont(c_acctbal, 0.75), 4) AS q75 FROM dirty""")
def _statistics(spark, sf_dir):
    return rounded(Q.compute_statistics(dirty(spark, sf_dir).select("c_acctbal", "c_mktsegment"))["numeric"], 4)


@query("qua_compute_statistics_top", f"""WITH {DIRTY} SELECT 'c_mktsegment' AS feature, c_mktsegment AS value, count(*) AS n,
   row_number() OVER (ORDER BY count(*) DESC, c_mktsegment)::INTEGER AS rank FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def _statistics_top(spark, sf_dir):
    return Q.compute_statistics(dirty(spark, sf_dir).select("c_acctbal", "c_mktsegment"))["top_values"]


@query("qua_profile", f"""WITH {DIRTY}, t AS (SELECT string_agg(c_mktsegment || '=' || n, ',' ORDER BY n DESC, c_mktsegment) AS s
     FROM (SELECT c_mktsegment, count(*) AS n FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY 1))
   SELECT 'c_acctbal' AS feature, count(*) AS rows, count(*) - count(c_acctbal) AS missing, 'numeric' AS kind, round((count(*) - count(c_acctbal)) / count(*)::DOUBLE, 4) AS missing_rate,
     count(DISTINCT c_acctbal) AS distinct_values, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max,
     round(quantile_cont(c_acctbal, 0.5), 4) AS median, NULL AS top_values FROM dirty
   UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), 'categorical', round((count(*) - count(c_mktsegment)) / count(*)::DOUBLE, 4),
     count(DISTINCT c_mktsegment), NULL, NULL, NULL, NULL, NULL, (SELECT s FROM t) FROM dirty""")
def _profile(spark, sf_dir):
    return rounded(Q.profile(dirty(spark, sf_dir).select("c_acctbal", "c_mktsegment")), 4)


@query("qua_validate_rules", f"""WITH {DIRTY} SELECT 'required_columns' AS rule, 'income' AS column, 'missing columns' AS detail
   UNION ALL SELECT 'no_missing_values', 'c_acctbal', (count(*) - count(c_acctbal)) || ' missing values' FROM dirty
   UNION ALL SELECT 'data_type', 'c_nationkey', 'int, expected bigint'""")
def _rules(spark, sf_dir):
    return Q.validate_rules(
        dirty(spark, sf_dir),
        [
            {"type": "required_columns", "params": {"columns": ["c_custkey", "income"]}},
            {"type": "no_missing_values", "params": {"columns": ["c_custkey", "c_acctbal"]}},
            {"type": "data_type", "params": {"column": "c_nationkey", "expected_type": "bigint"}},
        ],
    )


@query("qua_validation_summary", """SELECT 3 AS total_rules, 1::BIGINT AS violations, false AS is_valid, round(2 / 3.0::DOUBLE, 6) AS success_rate FROM customer LIMIT 1""")
def _summary(spark, sf_dir):
    rules = [
        {"type": "required_columns", "params": {"columns": ["c_custkey"]}},
        {"type": "no_missing_values", "params": {"columns": ["c_custkey", "c_mktsegment"]}},
        {"type": "data_type", "params": {"column": "c_acctbal", "expected_type": "double"}},
    ]
    return rounded(Q.validation_summary(Q.validate_rules(dirty(spark, sf_dir), rules), len(rules)))


@query("qua_validate_dataframe", f"""WITH {DIRTY} SELECT 'error' AS level, 'required_columns' AS check, 'income' AS detail
   UNION ALL SELECT 'error', 'numeric_columns', 'c_mktsegment'
   UNION ALL SELECT 'error', 'max_rows', count(*)::VARCHAR FROM dirty
   UNION ALL SELECT 'warning', 'duplicate_rows', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)))::VARCHAR FROM dirty
   UNION ALL SELECT 'warning', 'missing_values', 'c_acctbal=' || (count(*) - count(c_acctbal)) FROM dirty
   UNION ALL SELECT 'warning', 'missing_values', 'c_mktsegment=' || (count(*) - count(c_mktsegment)) FROM dirty""")
def _validate(spark, sf_dir):
    return Q.validate_dataframe(dirty(spark, sf_dir), 1, 100, ["c_custkey", "income"], ["c_acctbal", "c_mktsegment"])


@query("qua_quality_rules", f"""WITH {DIRTY}, r AS (
   SELECT 'balance present' AS name, 'completeness' AS type, 'c_acctbal' AS column, count(*) - count(c_acctbal) AS violations, count(*) AS n, 90.0::DOUBLE AS threshold FROM dirty
   UNION ALL SELECT 'balance in range', 'range', 'c_acctbal', count(*) FILTER (c_acctbal NOT BETWEEN 0 AND 9000), count(*), 80.0 FROM dirty
   UNION ALL SELECT 'segment format', 'format', 'c_mktsegment', count(*) FILTER (NOT regexp_matches(c_mktsegment, '^[A-M]')), count(*), 95.0 FROM dirty
   UNION ALL SELECT 'key unique', 'uniqueness', 'c_custkey', count(c_custkey) - count(DISTINCT c_custkey), count(c_custkey), 99.0 FROM dirty)
   SELECT name, type, "column", violations, round((1 - violations / n::DOUBLE) * 100, 6) AS pass_rate, threshold, (1 - violations / n::DOUBLE) * 100 >= threshold AS passed FROM r""")
def _quality_rules(spark, sf_dir):
    return rounded(
        Q.quality_rules(
            dirty(spark, sf_dir),
            [
                {"name": "balance present", "type": "completeness", "column": "c_acctbal", "threshold": 90},
                {"name": "balance in range", "type": "range", "column": "c_acctbal", "min": 0, "max": 9000, "threshold": 80},
                {"name": "segment format", "type": "format", "column": "c_mktsegment", "pattern": "^[A-M]", "threshold": 95},
                {"name": "key unique", "type": "uniqueness", "column": "c_custkey", "threshold": 99},
            ],
        )
    )


@query("qua_quality_dimensions", """WITH d AS (SELECT o_orderkey % 100 AS k, o_orderstatus, o_totalprice, o_orderdate FROM orders), f AS (
   SELECT 100.0::DOUBLE AS completeness, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) / count(*)::DOUBLE * 100 AS uniqueness,
   count(*) FILTER (o_totalprice > 5000) / count(*)::DOUBLE * 100 AS validity, count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') / count(*)::DOUBLE * 100 AS timeliness FROM d)
   SELECT completeness, round(uniqueness, 6) AS uniqueness, round(validity, 6) AS validity, round(timeliness, 6) AS timeliness,
   round((completeness + uniqueness + validity + timeliness) / 4, 6) AS overall FROM f""")
def _dimensions(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("k"), "o_orderstatus", "o_totalprice", "o_orderdate")
    return rounded(Q.quality_dimensions(rows, F.col("o_totalprice") > 5000, "o_orderdate", F.lit("2000-01-01").cast("timestamp_ntz")))


DEGRADED_SQL = f"""WITH cur AS (SELECT value, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
   ref AS (SELECT value, user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'),
   o AS ({_fence_sql("value", "cur")} UNION ALL {_fence_sql("user_id", "cur")}),
   m AS (SELECT 'value' AS column, 0.0::DOUBLE AS c, 0.0::DOUBLE AS r, count(*) AS n FROM cur UNION ALL
         SELECT 'user_id', (count(*) - count(user_id)) / count(*)::DOUBLE, 0.0, count(*) FROM cur UNION ALL SELECT 'event_type', 0.0, 0.0, count(*) FROM cur),
   x AS (SELECT m."column", c AS missing_rate, c - r AS missing_delta, coalesce(outliers, 0) / n::DOUBLE AS outlier_rate FROM m LEFT JOIN o ON o.feature = m."column"),
   deg AS (SELECT *, concat_ws(';', CASE WHEN missing_delta > 0.05 THEN 'missing_values' END, CASE WHEN outlier_rate > 0.1 THEN 'outliers' END) AS affected_by FROM x)
"""


def degraded(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    new = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    cur = events.where(new).withColumn("user_id", F.when(F.col("event_id") % 6 != 0, F.col("user_id")))
    return Q.quality_degradation(cur, events.where(~new), ["value", "user_id", "event_type"])


@query("qua_quality_degradation", DEGRADED_SQL + """SELECT "column", round(missing_rate, 6) AS missing_rate, round(missing_delta, 6) AS missing_delta,
   round(outlier_rate, 6) AS outlier_rate, affected_by FROM deg WHERE affected_by <> ''""")
def _degradation(spark, sf_dir):
    return rounded(degraded(spark, sf_dir))


# ------------------------------------------------------------------ preprocessing


@query("pre_drop_columns", "SELECT p_partkey, p_size FROM part")
def _drop(spark, sf_dir):
    return P.drop_columns(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_retailprice", "absent"])


@query("pre_fill_missing", f"""WITH {DIRTY} SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM dirty)), 4) AS by_mean,
   round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM dirty)), 4) AS by_median,
   coalesce(c_mktsegment, (SELECT c_mktsegment FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS by_mode FROM dirty""")
def _fill(spark, sf_dir):
    rows = dirty(spark, sf_dir).select(
        "c_custkey", F.col("c_acctbal").alias("by_mean"), F.col("c_acctbal").alias("by_median"), F.col("c_mktsegment").alias("by_mode")
    )
    out = P.fill_missing(rows, ["by_mean"], "mean")
    return rounded(P.fill_missing(P.fill_missing(out, ["by_median"], "median"), ["by_mode"], "most_frequent"), 4)


@query("pre_one_hot", f"""WITH {DIRTY} SELECT c_custkey, coalesce(c_mktsegment = 'AUTOMOBILE', false)::INTEGER AS c_mktsegment_AUTOMOBILE,
   coalesce(c_mktsegment = 'BUILDING', false)::INTEGER AS c_mktsegment_BUILDING, coalesce(c_mktsegment = 'FURNITURE', false)::INTEGER AS c_mktsegment_FURNITURE,
   coalesce(c_mktsegment = 'HOUSEHOLD', false)::INTEGER AS c_mktsegment_HOUSEHOLD, coalesce(c_mktsegment = 'MACHINERY', false)::INTEGER AS c_mktsegment_MACHINERY FROM dirty""")
def _one_hot(spark, sf_dir):
    return P.one_hot(dirty(spark, sf_dir).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("pre_one_hot_drop_first", """SELECT p_partkey, (p_type = 'LARGE')::INTEGER AS p_type_LARGE, (p_type = 'MEDIUM')::INTEGER AS p_type_MEDIUM,
   (p_type = 'PROMO')::INTEGER AS p_type_PROMO,
   (p_type = 'SMALL')::INTEGER AS p_type_SMALL, (p_type = 'STANDARD')::INTEGER AS p_type_STANDARD FROM part""")
def _one_hot_drop_first(spark, sf_dir):
    return P.one_hot(read(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type"], drop_first=True)


@query("pre_label_encode", f"""WITH {DIRTY}, codes AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code
   FROM (SELECT DISTINCT c_mktsegment FROM dirty WHERE c_mktsegment IS NOT NULL)) SELECT c_custkey, code AS c_mktsegment FROM dirty LEFT JOIN codes USING (c_mktsegment)""")
def _label_encode(spark, sf_dir):
    return P.label_encode(dirty(spark, sf_dir).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("pre_standard_scale", """SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size,
   round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part""")
def _scale(spark, sf_dir):
    return rounded(P.standard_scale(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query("pre_apply_steps", f"""WITH {DIRTY}, f AS (SELECT c_custkey, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM dirty)) AS a FROM dirty)
   SELECT c_custkey, round((a - (SELECT avg(a) FROM f)) / (SELECT stddev_pop(a) FROM f), 6) AS c_acctbal FROM f""")
def _steps(spark, sf_dir):
    return rounded(
        P.apply_steps(
            dirty(spark, sf_dir),
            [
                {"type": "drop_columns", "params": {"columns": ["c_nationkey", "c_mktsegment"]}},
                {"type": "fill_missing", "params": {"columns": ["c_acctbal"], "strategy": "mean"}},
                {"type": "standard_scale", "params": {"columns": ["c_acctbal"]}},
            ],
        )
    )


@query("pre_train_validation_test_split", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
   SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN rn <= floor(n * 0.9 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r""")
def _split(spark, sf_dir):
    return P.train_validation_test_split(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("pre_stratified_split", """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey)) AS rn,
   count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM r""")
def _stratified(spark, sf_dir):
    return P.stratified_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query("pre_cap_outliers", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
   SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) AS value FROM events, q""")
def _cap(spark, sf_dir):
    return rounded(P.cap_outliers(read(spark, sf_dir, "events").select("event_id", "value"), ["value"]))


@query("pre_robust_scale", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
   SELECT event_id, event_type, round((value - m) / (b - a), 6) AS value FROM events JOIN q USING (event_type)""")
def _robust(spark, sf_dir):
    return rounded(P.robust_scale(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", ["value"]))


@query("pre_engineer", """SELECT p_partkey, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice, (p_size ** 2)::DOUBLE AS p_size_pow2, (p_size ** 3)::DOUBLE AS p_size_pow3,
   round(CASE WHEN p_size - 5 = 0 THEN 0 ELSE p_retailprice / (p_size - 5) END, 6) AS p_retailprice_per_offset FROM part""")
def _engineer(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("offset", F.col("p_size") - 5)
    out = P.engineer(rows, [("p_size", "p_retailprice")], {"p_size": 3}, [("p_retailprice", "offset")])
    return rounded(
        out.select("p_partkey", "p_size_x_p_retailprice", "p_size_pow2", "p_size_pow3", "p_retailprice_per_offset"), 6, p_size_x_p_retailprice=4
    )


def _unit(seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || c_custkey || '|' || copy), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


BANDS = """bd AS (SELECT c_custkey, c_acctbal / 100 AS bal, c_nationkey::DOUBLE AS nat, length(c_mktsegment)::DOUBLE AS seg,
   CASE WHEN c_acctbal > 9000 THEN 'top' WHEN c_acctbal < 0 THEN 'low' ELSE 'mid' END AS band FROM customer)"""


@query("pre_smote", f"""WITH {BANDS}, c AS (SELECT band, count(*) AS n, max(count(*)) OVER () AS most FROM bd GROUP BY band),
   d AS (SELECT a.c_custkey, b.c_custkey AS other, b.bal AS b2, b.nat AS n2, b.seg AS s2, row_number() OVER (PARTITION BY a.c_custkey ORDER BY sqrt((a.bal - b.bal) ** 2 + (a.nat - b.nat) ** 2 + (a.seg - b.seg) ** 2), b.c_custkey) AS i,
         count(*) OVER (PARTITION BY a.c_custkey) AS others FROM bd a JOIN bd b ON a.band = b.band AND a.c_custkey != b.c_custkey WHERE a.band != 'mid'),
   k AS (SELECT bd.*, n, most, row_number() OVER (PARTITION BY band ORDER BY md5('42|' || c_custkey), c_custkey) AS r FROM bd JOIN c USING (band) WHERE n < most),
   m AS (SELECT *, unnest(range(1, ((most - n) // n + CASE WHEN r <= (most - n) % n THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy FROM k),
   p AS (SELECT m.*, other, b2, n2, s2, {_unit('42g')} AS gap FROM m JOIN d USING (c_custkey) WHERE i = 1 + floor({_unit('42n')} * least(others, 5)))
   SELECT c_custkey AS source, other AS neighbour, copy, round(bal + gap * (b2 - bal), 6) AS bal, round(nat + gap * (n2 - nat), 6) AS nat, round(seg + gap * (s2 - seg), 6) AS seg, band FROM p""")
def _smote(spark, sf_dir):
    balance = F.col("c_acctbal")
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", (balance / 100).alias("bal"), F.col("c_nationkey").cast("double").alias("nat"), F.length("c_mktsegment").cast("double").alias("seg"),
        F.when(balance > 9000, "top").when(balance < 0, "low").otherwise("mid").alias("band"),
    )
    return rounded(P.smote(rows, "c_custkey", ["bal", "nat", "seg"], "band"))
