"""Sources, filters, aggregates, windows, rankings and set operations on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallywatch.functions import bands, text
from tallywatch.operators import aggregates as A
from tallywatch.operators import drift, filters, preprocess, ranking, setops, windows
from tallywatch.operators import summaries as S
from tallywatch.plans.bindings import query, read, rounded
from tallywatch.session import shared_folder
from tallywatch.sources import tables

# ------------------------------------------------------------------ sources


@query("src_load_table", "SELECT * FROM supplier")
def _load(spark, sf_dir):
    return tables.load_table(spark, f"{sf_dir}/supplier.parquet")


@query(
    "src_data_preview",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
       ORDER BY c_custkey LIMIT 100""",
)
def _preview(spark, sf_dir):
    odd = F.when(F.col("c_custkey") % 14 == 0, float("inf")).when(F.col("c_custkey") % 7 == 0, float("nan")).otherwise(F.col("c_acctbal"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", odd.alias("c_acctbal"), "c_mktsegment")
    return tables.data_preview(rows, ["c_custkey"], 100)


@query("src_sync_table", "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50")
def _sync(spark, sf_dir):
    return tables.sync_table(read(spark, sf_dir, "customer"), ["c_acctbal > 5000", "c_mktsegment = 'BUILDING'"], 50, ["c_custkey"])


GAPPY = """(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
   CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer)"""


def gappy(spark, sf_dir):
    """Customers with balances and segments missing at fixed keys."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        "c_nationkey",
    )


@query(
    "src_sync_statistics",
    f"""WITH g AS {GAPPY}, n AS (SELECT count(*) AS rows, count(*) - count(c_custkey) AS a, count(*) - count(c_acctbal) AS b,
          count(*) - count(c_mktsegment) AS c, count(*) - count(c_nationkey) AS d FROM g)
        SELECT 'c_custkey' AS column, 'bigint' AS type, rows, a AS nulls FROM n UNION ALL SELECT 'c_acctbal', 'double', rows, b FROM n
        UNION ALL SELECT 'c_mktsegment', 'string', rows, c FROM n UNION ALL SELECT 'c_nationkey', 'int', rows, d FROM n""",
)
def _sync_statistics(spark, sf_dir):
    return tables.sync_statistics(gappy(spark, sf_dir))


@query(
    "src_dataset_metadata",
    """SELECT p::INTEGER AS position, c AS column, t AS type, (SELECT count(*) FROM supplier) AS num_rows, 4 AS num_columns
       FROM (VALUES (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double')) v(p, c, t)""",
)
def _metadata(spark, sf_dir):
    return tables.dataset_metadata(read(spark, sf_dir, "supplier"))


@query(
    "src_upsert_latest",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal,
       CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM supplier
       UNION ALL SELECT s_suppkey + 100000000, s_acctbal, 2 FROM supplier WHERE s_suppkey % 10 = 1""",
)
def _upsert(spark, sf_dir):
    base = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.lit(1).alias("version"))
    changed = base.where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(2).alias("version"))
    added = base.where("s_suppkey % 10 = 1").select((F.col("s_suppkey") + 100000000).alias("s_suppkey"), "s_acctbal", F.lit(2).alias("version"))
    return tables.upsert_latest(base, changed.unionByName(added), ["s_suppkey"], "version")


def _written(spark, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("src_write_split", """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
   SELECT CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN rn <= floor(n * 0.9 + 1e-9) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM r GROUP BY 1""")
def _write_split(spark, sf_dir):
    path = _written(spark, "splits")
    rows = preprocess.train_validation_test_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    tables.write_table(rows, path, ["split"])
    back = tables.load_table(spark, path, "parquet")
    return rounded(back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 1)


@query("src_export_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _export_csv(spark, sf_dir):
    path = _written(spark, "customers")
    tables.export_csv(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return tables.load_table(spark, path, "csv", "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("src_export_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _export_json(spark, sf_dir):
    path = _written(spark, "suppliers")
    tables.export_json(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return tables.load_table(spark, path, "json").select("s_suppkey", "s_name", "s_acctbal")


@query("src_load_csv_flexible", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _csv_flexible(spark, sf_dir):
    path = _written(spark, "parts")
    read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.csv(path, sep=";", header=True)
    back = tables.load_csv_flexible(spark, path)
    return back.select(F.col("p_partkey").cast("bigint"), "p_name", F.col("p_retailprice").cast("double"))


# ------------------------------------------------------------------ filters


@query("fil_align_columns", """SELECT 'ref' AS side, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0
   UNION ALL SELECT 'cur', c_nationkey, c_acctbal FROM customer WHERE c_custkey % 2 = 1""")
def _align(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    ref, cur = filters.align_columns(
        c.where("c_custkey % 2 = 0").select("c_nationkey", "c_acctbal", "c_name"),
        c.where("c_custkey % 2 = 1").select("c_acctbal", "c_mktsegment", "c_nationkey"),
    )
    return S.pair_sides(ref, cur)


@query("fil_split_by_time", """SELECT o_orderkey, 'ref' AS side FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-01-01'
   UNION ALL SELECT o_orderkey, 'cur' FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-06-01' AND TIMESTAMP '2000-01-01'""")
def _split_time(spark, sf_dir):
    rows = filters.split_by_time(
        read(spark, sf_dir, "orders"), "o_orderdate", ("1995-01-01", "1998-01-01"), ("1997-06-01", "2000-01-01")
    )
    return rows.select("o_orderkey", "side")


@query("fil_split_by_position", """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.7)
   THEN 'ref' ELSE 'cur' END AS side FROM orders""")
def _split_position(spark, sf_dir):
    return filters.split_by_position(read(spark, sf_dir, "orders"), "o_orderkey", 0.7).select("o_orderkey", "side")


@query("fil_drop_and_dropna", f"SELECT c_custkey, c_acctbal, c_mktsegment FROM {GAPPY} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def _dropna(spark, sf_dir):
    return filters.drop_and_dropna(gappy(spark, sf_dir), ["c_nationkey", "absent"])


@query("fil_text_search", """SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) AND p_brand = 'Brand#2'""")
def _search(spark, sf_dir):
    return filters.text_search(read(spark, sf_dir, "part"), "RING", ["p_name", "p_type"], p_brand="Brand#2").select("p_partkey", "p_name")


@query("fil_text_search_documents", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def _search_documents(spark, sf_dir):
    return filters.text_search(read(spark, sf_dir, "documents"), "LICENSE", ["text", "source"]).select("doc_id", "lang")


@query("fil_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def _time_range(spark, sf_dir):
    return filters.time_range_filter(read(spark, sf_dir, "events"), "ts", "7d", "2024-01-20").select("event_id", "ts")


@query("fil_json_field", """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') = '69'""")
def _json_field(spark, sf_dir):
    rows = filters.json_field_filter(read(spark, sf_dir, "events"), "props", "k", "69")
    return rows.select("event_id", filters.json_field("props", "k").alias("k"))


# ------------------------------------------------------------------ joins


@query("joi_attach_labels", """SELECT d.doc_id, d.n_chars > 500 AS prediction, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _attach(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("prediction"))
    return filters.attach_labels(docs, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("joi_grid_rows", """SELECT c_custkey, g AS grid, c_acctbal + g * 100.0::DOUBLE AS shifted FROM customer, (SELECT unnest(range(0, 5))::INTEGER AS g)""")
def _grid(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("grid"))
    return rows.select("c_custkey", "grid", (F.col("c_acctbal") + F.col("grid") * 100.0).alias("shifted"))


# ------------------------------------------------------------------ aggregates


@query("agg_value_counts", f"""WITH g AS {GAPPY} SELECT 'c_mktsegment' AS feature, c_mktsegment AS value, count(*) AS n,
   round(count(*) / (SELECT count(c_mktsegment) FROM g)::DOUBLE, 6) AS share FROM g WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
   UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*), round(count(*) / (SELECT count(*) FROM g)::DOUBLE, 6) FROM g GROUP BY c_nationkey""")
def _value_counts(spark, sf_dir):
    return rounded(A.value_counts(gappy(spark, sf_dir), ["c_mktsegment", "c_nationkey"]))


DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
    round(max({c})::DOUBLE, 4) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50,
    round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75 FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
)


@query("agg_describe", DESCRIBE)
def _describe(spark, sf_dir):
    return rounded(A.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]), 4)


@query("agg_nunique", """SELECT 'l_suppkey' AS feature, count(DISTINCT l_suppkey) AS distinct_values FROM lineitem
   UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""")
def _nunique(spark, sf_dir):
    return A.distinct_counts(read(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"])


@query("agg_quantile", """SELECT 'o_totalprice' AS feature, s::DOUBLE AS share, round(quantile_cont(o_totalprice, s::DOUBLE), 4) AS quantile,
   count(*) AS n FROM orders, (VALUES (0.0), (0.05), (0.37), (0.95), (1.0)) t(s) GROUP BY s""".replace("quantile_cont(o_totalprice, s::DOUBLE)",
   "(list_sort(list(o_totalprice))[floor(s::DOUBLE * (count(*) - 1))::BIGINT + 1] + (list_sort(list(o_totalprice))[ceil(s::DOUBLE * (count(*) - 1))::BIGINT + 1] - list_sort(list(o_totalprice))[floor(s::DOUBLE * (count(*) - 1))::BIGINT + 1]) * (s::DOUBLE * (count(*) - 1) - floor(s::DOUBLE * (count(*) - 1))))"))
def _quantile(spark, sf_dir):
    return rounded(A.quantile(read(spark, sf_dir, "orders"), "o_totalprice", [0.0, 0.05, 0.37, 0.95, 1.0]), 4, share=2)


@query("agg_stddev_pop", """SELECT 'l_quantity' AS feature, round(stddev_pop(l_quantity), 6) AS stddev_pop FROM lineitem
   UNION ALL SELECT 'l_tax', round(stddev_pop(l_tax), 6) FROM lineitem""")
def _spread(spark, sf_dir):
    return rounded(A.spread(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]))


@query("agg_correlation", """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, 0.0::DOUBLE AS constant FROM lineitem GROUP BY l_returnflag""")
def _correlation(spark, sf_dir):
    return rounded(
        read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
            A.correlation(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"),
            A.correlation(F.col("l_quantity"), F.lit(1.0)).alias("constant"),
        )
    )


@query("agg_iqr_outliers", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
   SELECT event_id, 'value' AS feature, value, round(a - 1.5 * (b - a), 6) AS low, round(b + 1.5 * (b - a), 6) AS high FROM events, q
   WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def _iqr(spark, sf_dir):
    return rounded(A.iqr_outliers(read(spark, sf_dir, "events"), ["event_id"], ["value"]))


@query("agg_group_by", """SELECT p_partkey, p_size::VARCHAR AS group_key, count(*) OVER (PARTITION BY p_size) AS group_size FROM part""")
def _group_by(spark, sf_dir):
    return A.group_by(read(spark, sf_dir, "part"), "p_size").select("p_partkey", "group_key", "group_size")


@query("agg_percentage", """SELECT c_nationkey, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (c_acctbal > 0) * 100.0 / count(*) END, 6) AS percent,
   round(CASE WHEN min(c_acctbal) = 0 THEN 100 ELSE (max(c_acctbal) - min(c_acctbal)) / min(c_acctbal) * 100 END, 4) AS change FROM customer GROUP BY c_nationkey""")
def _percentage(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") > 0).alias("a"), F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")
    )
    return rounded(
        c.select("c_nationkey", bands.percentage(F.col("a"), F.col("n")).alias("percent"), bands.percentage_change(F.col("lo"), F.col("hi")).alias("change")),
        6,
        change=4,
    )


@query("agg_confusion_matrix", """SELECT (l_returnflag = 'R')::INTEGER AS label, (l_discount >= 0.05)::INTEGER AS prediction, count(*) AS n,
   round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 6) AS percent FROM lineitem GROUP BY ALL""")
def _confusion(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("p")
    )
    return rounded(A.confusion_matrix(rows, "y", "p"))


@query("agg_metric_aggregation", """SELECT event_type, round(sum(value), 4) AS sum, round(avg(value), 6) AS average, count(*) AS count, min(value) AS min, max(value) AS max,
   round(count(*) / 30.0::DOUBLE, 6) AS rate, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6) AS ratio,
   round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS percentile FROM events GROUP BY event_type""")
def _metric_aggregation(spark, sf_dir):
    return rounded(A.metric_aggregation(read(spark, sf_dir, "events"), ["event_type"], days=30.0, good=F.col("value") > 50), 6, sum=4)


@query("agg_correlation_importance", """SELECT 'l_quantity' AS feature, round(abs(corr(l_quantity, (l_returnflag = 'R')::INTEGER)), 6) AS importance FROM lineitem
   UNION ALL SELECT 'l_discount', round(abs(corr(l_discount, (l_returnflag = 'R')::INTEGER)), 6) FROM lineitem
   UNION ALL SELECT 'l_extendedprice', round(abs(corr(l_extendedprice, (l_returnflag = 'R')::INTEGER)), 6) FROM lineitem""")
def _correlation_importance(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(A.correlation_importance(rows, ["l_quantity", "l_discount", "l_extendedprice"], "y"))


@query("agg_catalog_summary", """SELECT o_orderstatus AS status, count(*) AS n, (SELECT count(*) FROM orders) AS total,
   (SELECT round(sum(o_totalprice), 1) FROM orders) AS total_o_totalprice, (SELECT round(avg(o_totalprice), 4) FROM orders) AS mean_o_totalprice
   FROM orders GROUP BY o_orderstatus""")
def _catalog(spark, sf_dir):
    rows = A.catalog_summary(read(spark, sf_dir, "orders"), "o_orderstatus", ["o_totalprice"], ["o_totalprice"])
    return rounded(rows, 4, total_o_totalprice=1)


# ------------------------------------------------------------------ windows

SERIES_SQL = """series AS (SELECT user_id % 5 AS model_id, event_type AS metric, CAST(ts AS DATE) AS ts, avg(value) AS value FROM events GROUP BY ALL)"""


def daily_series(spark, sf_dir):
    """Daily mean value per model and metric."""
    return read(spark, sf_dir, "events").groupBy(
        (F.col("user_id") % 5).alias("model_id"), F.col("event_type").alias("metric"), F.to_date("ts").alias("ts")
    ).agg(F.avg("value").alias("value"))


@query("win_rank_by", """SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey)::INTEGER AS rank FROM customer""")
def _rank_by(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return windows.rank_by(rows, ["c_nationkey"], "c_acctbal", "c_custkey", absolute=True)


@query("win_metric_trend", f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id, metric ORDER BY ts DESC) AS rn FROM series),
   t AS (SELECT model_id, metric, max(value) FILTER (rn = 1) AS current, max(value) FILTER (rn = 2) AS previous FROM r WHERE rn <= 2 GROUP BY ALL),
   c AS (SELECT *, (current - previous) / previous * 100 AS change_percentage FROM t WHERE previous IS NOT NULL)
   SELECT model_id, metric, round(current, 6) AS current, round(previous, 6) AS previous, round(change_percentage, 4) AS change_percentage,
   CASE WHEN change_percentage > 1 THEN 'improving' WHEN change_percentage < -1 THEN 'declining' ELSE 'stable' END AS trend FROM c""")
def _trend(spark, sf_dir):
    return rounded(windows.metric_trend(daily_series(spark, sf_dir)), 6, change_percentage=4)


@query("win_ecdf", """WITH v AS (SELECT value, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS c_ref, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS c_cur FROM events GROUP BY value),
   t AS (SELECT sum(c_ref) AS n, sum(c_cur) AS m FROM v)
   SELECT value, round(sum(c_ref) OVER w / n::DOUBLE, 6) AS ref_share, round(sum(c_cur) OVER w / m::DOUBLE, 6) AS cur_share, lead(value) OVER w AS next_value
   FROM v, t WINDOW w AS (ORDER BY value)""")
def _ecdf(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "ref").otherwise("cur").alias("side"), F.lit("value").alias("feature"), "value"
    )
    e = drift.ecdf(S.value_counts_by_side(rows))
    return rounded(
        e.select(
            "value",
            ((F.col("before_c_ref") + F.col("c_ref")) / F.col("total_c_ref")).alias("ref_share"),
            ((F.col("before_c_cur") + F.col("c_cur")) / F.col("total_c_cur")).alias("cur_share"),
            "next_value",
        )
    )


@query("win_last_n_windows", """SELECT size AS "window", count(*) AS n, round(avg(value), 6) AS mean_value FROM
   (SELECT value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events), (VALUES (50), (100), (200), (500)) t(size) WHERE rn <= size GROUP BY size""")
def _last_n(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.lit("value").alias("feature"), "value", "ts", "event_id")
    recent = drift.last_rows(rows, ["feature"], [F.col("ts").desc(), F.col("event_id").desc()])
    return rounded(recent.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


@query("win_trailing_baseline", f"""WITH {SERIES_SQL}, b AS (SELECT model_id, metric AS feature, ts, value AS batch_mean,
   avg(value) OVER (PARTITION BY model_id, metric ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS baseline FROM series)
   SELECT model_id, feature, ts, round(batch_mean, 6) AS batch_mean, round(baseline, 6) AS baseline,
   round(abs(batch_mean - baseline) / (abs(baseline) + 1e-8), 6) AS drift_score, abs(batch_mean - baseline) / (abs(baseline) + 1e-8) > 0.1 AS drift_detected
   FROM b WHERE baseline IS NOT NULL""")
def _trailing(spark, sf_dir):
    batches = daily_series(spark, sf_dir).withColumnsRenamed({"metric": "feature", "value": "batch_mean"})
    return rounded(windows.trailing_baseline(batches))


ATTR_SQL = """attr AS (SELECT c_custkey, 10.0::DOUBLE AS base, feature, attribution FROM (
   SELECT c_custkey, 'balance' AS feature, c_acctbal / 1000 AS attribution FROM customer
   UNION ALL SELECT c_custkey, 'nation', (c_nationkey - 12) / 4.0::DOUBLE FROM customer
   UNION ALL SELECT c_custkey, 'segment', length(c_mktsegment) - 8.25::DOUBLE FROM customer))"""


def attributions(spark, sf_dir):
    """Three attributions per customer, from balance, nation and segment."""
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lit(10.0).alias("base"),
        (F.col("c_acctbal") / 1000).alias("balance"),
        ((F.col("c_nationkey") - 12) / 4.0).alias("nation"),
        (F.length("c_mktsegment") - F.lit(8.25)).cast("double").alias("segment"),
    )
    return rows.unpivot(["c_custkey", "base"], ["balance", "nation", "segment"], "feature", "attribution")


@query("win_waterfall", f"""WITH {ATTR_SQL}
   SELECT c_custkey, row_number() OVER w::INTEGER AS step, feature, round(attribution, 6) AS attribution, round(base + sum(attribution) OVER w, 6) AS cumulative
   FROM attr WINDOW w AS (PARTITION BY c_custkey ORDER BY abs(attribution) DESC, feature ROWS UNBOUNDED PRECEDING)
   UNION ALL SELECT c_custkey, 0, 'base', 10.0, 10.0 FROM customer
   UNION ALL SELECT c_custkey, 4, 'prediction', 0.0, round(10.0 + sum(attribution), 6) FROM attr GROUP BY c_custkey""")
def _waterfall(spark, sf_dir):
    return rounded(windows.waterfall(attributions(spark, sf_dir), "c_custkey", "base"))


@query("win_importance_change", f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id, metric ORDER BY ts DESC) AS rn FROM series),
   t AS (SELECT model_id, metric AS feature, max(value) FILTER (rn = 1) / 100 AS current, max(value) FILTER (rn = 2) / 100 AS previous FROM r WHERE rn <= 2 GROUP BY ALL)
   SELECT model_id, feature, round(current, 6) AS current, round(previous, 6) AS previous, round(current - previous, 6) AS delta,
   abs(current - previous) < 0.01 AS stable, abs(current - previous) > 0.1 AS changed FROM t WHERE previous IS NOT NULL""")
def _importance_change(spark, sf_dir):
    history = daily_series(spark, sf_dir).select("model_id", F.col("metric").alias("feature"), "ts", (F.col("value") / 100).alias("importance"))
    return rounded(windows.importance_change(history))


@query("win_sliding_request_count", """WITH s AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS second, count(*) AS requests FROM events GROUP BY ALL)
   SELECT user_id, second, requests, (sum(requests) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))::BIGINT AS in_window,
   sum(requests) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM s""")
def _sliding(spark, sf_dir):
    return windows.sliding_request_count(read(spark, sf_dir, "events"), "user_id", "ts", span=3600, limit=2, chunk=86400)


# ------------------------------------------------------------------ rankings


@query("top_values", """WITH c AS (SELECT 'p_brand' AS feature, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
   UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type)
   SELECT * FROM (SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value)::INTEGER AS rank FROM c) WHERE rank <= 10""")
def _top_values(spark, sf_dir):
    return ranking.top_values(read(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("top_sort_by", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _sort_by(spark, sf_dir):
    return ranking.sort_by(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", ["s_suppkey"], True)


@query("top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def _top_groups(spark, sf_dir):
    return ranking.top_groups(read(spark, sf_dir, "events"), ["user_id"], 20)


@query("top_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def _newest(spark, sf_dir):
    return ranking.newest_first(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("top_page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _page(spark, sf_dir):
    return ranking.page(read(spark, sf_dir, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25, 50).select("o_orderkey")


@query("top_features", """SELECT p_type AS method, p_brand AS feature, round(avg(p_retailprice) - 950, 6) AS importance FROM part
   WHERE p_type = 'ECONOMY' AND p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY ALL ORDER BY abs(avg(p_retailprice) - 950) DESC, p_brand LIMIT 8""")
def _top_features(spark, sf_dir):
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("method"), F.col("p_brand").alias("feature")).agg(
        (F.avg("p_retailprice") - 950).alias("importance")
    )
    return rounded(ranking.top_features(rows, "ECONOMY", ["Brand#1", "Brand#2"], n=8))


# ------------------------------------------------------------------ set operations


@query("set_concat_sides", """SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE 'cur' END AS side, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL""")
def _concat(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    both = S.pair_sides(o.where(old).select("o_orderstatus"), o.where(~old).select("o_orderstatus"))
    return both.groupBy("side", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("set_schema_diff", """WITH l AS (SELECT column_name AS c FROM information_schema.columns WHERE table_name = 'customer'),
   r AS (SELECT replace(column_name, 's_', 'c_') AS c FROM information_schema.columns WHERE table_name = 'supplier')
   SELECT coalesce(l.c, r.c) AS column, CASE WHEN l.c IS NULL THEN 'cur_only' WHEN r.c IS NULL THEN 'ref_only' ELSE 'both' END AS presence FROM l FULL JOIN r ON l.c = r.c""")
def _schema_diff(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return setops.schema_diff(read(spark, sf_dir, "customer"), s.toDF(*[c.replace("s_", "c_", 1) for c in s.columns])).select("column", "presence")


DOUBLED = "(SELECT c_nationkey, c_mktsegment FROM customer UNION ALL SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 9 = 0)"


@query("set_duplicates", f"""SELECT (SELECT count(*) FROM {DOUBLED}) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) AS distinct_rows,
   (SELECT count(*) FROM {DOUBLED}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOUBLED})) AS duplicate_rows""")
def _duplicates(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    both = c.select("c_nationkey", "c_mktsegment").unionByName(c.where("c_custkey % 9 = 0").select("c_nationkey", "c_mktsegment"))
    return setops.duplicate_count(both)


@query("set_dedupe", "SELECT DISTINCT ON (c_nationkey, c_mktsegment) c_nationkey, c_mktsegment, c_custkey FROM customer ORDER BY c_nationkey, c_mktsegment, c_custkey")
def _dedupe(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    return setops.dedupe(rows, ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")])


# ------------------------------------------------------------------ functions


@query("fun_sanitize_string", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(0), ''), '<[^>]+>', '', 'g'), '[^\p{L}\p{N}_\s-]', '', 'g')) AS clean
   FROM (SELECT doc_id, '  <b>' || item || '</b> & more! ' AS text FROM (SELECT item_id AS doc_id, replace(text, chr(10), ' ') AS item FROM benchmark))""")
def _sanitize_string(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.concat(F.lit("  <b>"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("</b> & more! ")).alias("text")
    )
    return rows.select("doc_id", text.sanitize_string(F.col("text"), allow_special_chars=False).alias("clean"))


@query("fun_sanitize_input", r"""SELECT page_id, translate(html, '<>&"''/\', '') AS clean FROM pages""")
def _sanitize_input(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.sanitize_input(F.col("html")).alias("clean"))


@query("fun_patterns", r"""SELECT p_partkey, regexp_matches(p_size || '.' || (p_partkey % 10) || '.0', '^\d+\.\d+\.\d+$') AS semver,
   regexp_matches(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '@' ELSE ' ' END) || '.com', '^[^\s@]+@[^\s@]+\.[^\s@]+$') AS email FROM part""")
def _patterns(spark, sf_dir):
    version = F.concat("p_size", F.lit("."), F.col("p_partkey") % 10, F.lit(".0"))
    address = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("@"))).otherwise(F.col("p_name")), F.lit(".com"))
    return read(spark, sf_dir, "part").select("p_partkey", text.is_semver(version).alias("semver"), text.is_email(address).alias("email"))


@query("fun_predicates", """SELECT event_id FROM events WHERE event_type LIKE '%i%' AND event_type IN ('click', 'signup', 'view') AND value BETWEEN 10 AND 60""")
def _predicates(spark, sf_dir):
    return read(spark, sf_dir, "events").where(
        F.col("event_type").like("%i%") & F.col("event_type").isin("click", "signup", "view") & F.col("value").between(10, 60)
    ).select("event_id")


@query("fun_time_features", """SELECT event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, month(ts)::INTEGER AS month, isodow(ts) >= 6 AS is_weekend,
   round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE, 6) AS elapsed FROM events""")
def _time_features(spark, sf_dir):
    rows = preprocess.time_features(read(spark, sf_dir, "events"), "ts")
    elapsed = text.seconds_between(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return rounded(rows.select("event_id", "hour", "day_of_week", "month", "is_weekend", elapsed.alias("elapsed")))


@query("fun_linspace_bins", """WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
   SELECT c_custkey, CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 20.0::DOUBLE)), 19) AS INTEGER) AS bin,
   len(list_filter([0.0, 2500.0, 5000.0], lambda e: c_acctbal > e))::INTEGER AS interval,
   round(lo + (c_custkey % 5) * (hi - lo) / 4.0::DOUBLE, 6) AS grid_point FROM customer, r""")
def _linspace(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    r = c.agg(F.struct(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).alias("r"))
    rows = c.withColumn("r", r.scalar())
    lo, hi = F.col("r.lo"), F.col("r.hi")
    edges = F.array(*[F.lit(x) for x in (0.0, 2500.0, 5000.0)])
    return rounded(
        rows.select(
            "c_custkey",
            bands.equal_width_bin(F.col("c_acctbal"), lo, hi, 20).alias("bin"),
            bands.interval_bin(F.col("c_acctbal"), edges, 3).alias("interval"),
            F.get(bands.linspace(lo, hi, 5), (F.col("c_custkey") % 5).cast("int")).alias("grid_point"),
        )
    )


@query("fun_bands", """SELECT event_id, CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS level,
   CASE user_id % 6 WHEN 0 THEN value > 50 WHEN 1 THEN value < 50 WHEN 2 THEN value >= 50 WHEN 3 THEN value <= 50 WHEN 4 THEN abs(value - 50) < 1e-9 ELSE abs(value - 50) >= 1e-9 END AS met,
   round(CASE event_type WHEN 'click' THEN least(1, value / 100 / 0.5) WHEN 'view' THEN least(1, value / 100 / 2) ELSE least(1, value / 100) END, 6) AS score FROM events""")
def _bands(spark, sf_dir):
    ops = F.get(F.array(*[F.lit(o) for o in (">", "<", ">=", "<=", "==", "!=")]), (F.col("user_id") % 6).cast("int"))
    method = F.when(F.col("event_type") == "click", "population_stability_index").when(F.col("event_type") == "view", "kl_divergence").otherwise("wasserstein")
    return rounded(
        read(spark, sf_dir, "events").select(
            "event_id",
            bands.band(F.col("value"), (150, 80, 30), ("critical", "high", "medium", "low")).alias("level"),
            bands.meets(F.col("value"), ops, F.lit(50.0)).alias("met"),
            bands.normalised_score(method, F.col("value") / 100).alias("score"),
        )
    )


@query("fun_alert_message", """SELECT event_id, 'High value: ' || event_type || ' = ' || printf('%.4f', value) || ' > 100.0 for model ' || (user_id % 5) AS message FROM events WHERE value > 100""")
def _message(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("value > 100")
    return rows.select(
        "event_id",
        text.alert_message(F.lit("High value"), F.col("event_type"), F.col("value"), F.lit(">"), F.lit(100.0), F.col("user_id") % 5).alias("message"),
    )
