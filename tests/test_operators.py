import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.functions import text
from tallywatch.operators import alerts as A
from tallywatch.operators import explain as E
from tallywatch.operators import fairness as X
from tallywatch.operators import kpi, preprocess, scoring, windows
from tallywatch.operators import quality as Q
from tallywatch.sources import tables
from tallywatch.streaming import streams


# ------------------------------------------------------------------ validation and cleaning


def _found(df):
    return {(r["level"], r["check"]) for r in df.collect()}


def test_valid_frame(spark):
    df = spark.createDataFrame([(i, i * 1.5, i % 2) for i in range(5)], "feature1 int, feature2 double, target int")
    assert _found(Q.validate_dataframe(df, required=["feature1", "target"], numeric=["feature1"])) == set()


def test_missing_column_and_type_are_errors(spark):
    df = spark.createDataFrame([("a", 1.0)], "feature1 string, feature2 double")
    got = _found(Q.validate_dataframe(df, required=["target"], numeric=["feature1"]))
    assert got == {("error", "required_columns"), ("error", "numeric_columns")}


def test_gaps_copies_and_infinities_are_warnings(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("inf"))], "a int, b double")
    got = _found(Q.validate_dataframe(df))
    assert got == {("warning", "missing_values"), ("warning", "duplicate_rows"), ("warning", "infinite_values")}


def test_row_limits(spark):
    df = spark.range(3)
    assert _found(Q.validate_dataframe(df, min_rows=5)) == {("error", "min_rows")}
    assert _found(Q.validate_dataframe(df, max_rows=2)) == {("error", "max_rows")}


def test_string_cleaning(spark):
    df = spark.createDataFrame([("  hi  ",), ("a\x00b",), ("x" * 2000,), ("<script>alert(1)</script>ok",), ("a@b#c!",), (None,)], "t string")
    plain = [r[0] for r in df.select(text.sanitize_string(F.col("t"))).collect()]
    cut = [r[0] for r in df.select(text.sanitize_string(F.col("t"), 1000)).collect()]
    assert cut[2] == "x" * 1000
    assert plain == ["hi", "ab", "x" * 2000, "alert(1)ok", "a@b#c!", ""]
    bare = [r[0] for r in df.select(text.sanitize_string(F.col("t"), allow_special_chars=False)).collect()]
    assert bare[4] == "abc"


# ------------------------------------------------------------------ sources


def test_round_trips_and_separators(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for fmt, write in (("csv", tables.export_csv), ("json", tables.export_json), ("parquet", tables.write_table)):
        path = str(tmp_path / f"t.{fmt}")
        write(df, path)
        assert sorted(tuple(r) for r in tables.load_table(spark, path).select("k", "v").collect()) == [(1, "a"), (2, "b")]
    for name, sep in (("c", ","), ("s", ";"), ("t", "\t")):
        (tmp_path / f"{name}.txt").write_text(f"a{sep}b\n1{sep}2\n")
        assert tables.load_csv_flexible(spark, str(tmp_path / f"{name}.txt")).columns == ["a", "b"]
    (tmp_path / "none.txt").write_text("a\n1\n")
    with pytest.raises(ValueError):
        tables.load_csv_flexible(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.xlsx")


# ------------------------------------------------------------------ cooldown


def _cooldown_by_hand(points, gap, known=None):
    fired, last = [], known
    for us, event in sorted(points):
        if last is None or us - last >= gap:
            fired.append(event)
            last = us
    return sorted(fired)


@pytest.mark.parametrize("hot", [1, 5, 800, 9000])
def test_cooldown_against_a_loop(spark, hot):
    """Cooldowns shorter and longer than a range part, and longer than the data."""
    rng = random.Random(hot)
    rules = [("hot", "hot", "m", ">", 0.0, "high", "t", float(hot), None), ("rare", "rare", "n", ">", 0.0, "high", "t", 90.0, None)]
    points = [(i, "m", rng.randrange(0, 3000)) for i in range(900)] + [(1000 + i, "n", rng.randrange(0, 3000)) for i in range(60)]
    metrics = spark.createDataFrame([(i, 1, name, 1.0, s) for i, name, s in points], "event_id int, model_id int, metric_name string, metric_value double, s int")
    metrics = metrics.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    known = spark.createDataFrame([("hot", 7_000_000)], "rule_id string, last_us bigint")
    got = A.cooldown(A.match_rules(metrics, A.rule_table(spark, rules)), known).collect()
    for rule, name, gap, start in (("hot", "m", hot, 7), ("rare", "n", 90, None)):
        want = _cooldown_by_hand([(s, i) for i, n, s in points if n == name], gap, start)
        assert sorted(r["event_id"] for r in got if r["rule_id"] == rule) == want


def test_point_without_model_meets_every_rule(spark):
    rules = A.rule_table(spark, [("r", "r", "m", ">", 0.0, "high", "t", 0.0, ["7"])])
    df = spark.createDataFrame([(1, None, "m", 1.0), (2, 7, "m", 1.0), (3, 8, "m", 1.0)], "event_id int, model_id int, metric_name string, metric_value double")
    assert sorted(r["event_id"] for r in A.match_rules(df, rules).collect()) == [1, 2]


def test_rules_go_on_from_their_checkpoint(spark, tmp_path):
    def points(rows):
        df = spark.createDataFrame(rows, "event_id int, model_id int, metric_name string, metric_value double, s int")
        return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")

    schema = "event_id int, model_id int, metric_name string, metric_value double, ts timestamp"
    rules = A.rule_table(spark, [("r", "Rule", "m", ">", 0.0, "high", "t", 7200.0, None), ("now", "At once", "m", ">", 0.5, "low", "t", 0.0, None)])
    got = []
    # Points without a model, of one instant, within a cooldown that began in the run before, and a day later.
    for rows in ([(1, None, "m", 1.0, 0), (2, 1, "m", 0.4, 0)], [(3, 2, "m", 0.4, 7199), (4, 2, "m", 0.4, 7200)], [(5, 3, "n", 0.4, 90000)], [(6, 3, "m", 0.4, 90001)]):
        points(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.open_stream(spark, "parquet", schema, str(tmp_path / "in"))
        streams.run_rules(stream, rules, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        held = spark.read.format("statestore").load(str(tmp_path / "cp")).count()
        got.append((sorted(r.alert_id for r in spark.read.parquet(str(tmp_path / "out" / "alerts")).collect()), held))
    # The third run's point meets no rule.
    assert [a for a, _ in got] == [["now-1", "r-1"], ["now-1", "r-1", "r-4"], ["now-1", "r-1", "r-4"], ["now-1", "r-1", "r-4", "r-6"]]
    rows = spark.read.parquet(str(tmp_path / "out" / "alerts"))
    assert dict(rows.dtypes)["model_id"] == "int" and dict(rows.dtypes)["triggered_at"] == "timestamp"
    assert {r.alert_id: (r.model_id, r.triggered_at.timestamp()) for r in rows.collect()}["r-6"][0] == 3
    # The state of the first firing is there until a timer ends it.
    assert got[0][1] == 1 and [h for _, h in got][-1] == 1


def test_monitor_fires_at_its_frequency(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.open_stream(spark, "parquet", "id bigint", str(tmp_path / "in"))
    query = streams.start(stream, str(tmp_path / "cp"), streams.write_batches(str(tmp_path / "out")), "3 seconds")
    try:
        query.processAllAvailable()
        spark.range(5, 9).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        from datetime import datetime

        fired = {p["batchId"]: datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")) for p in query.recentProgress if p["numInputRows"] > 0}
        assert set(fired) == {0, 1} and (fired[1] - fired[0]).total_seconds() > 0.5
        # Triggers fall on multiples of the interval.
        assert fired[1].timestamp() % 3 < 0.5 or fired[1].timestamp() % 3 > 2.5
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).where("batch_id = 1").collect()) == [5, 6, 7, 8]


def test_stream_of_rules_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, 1, "m", rng.random(), i * 13 + rng.randrange(10)) for i in range(300)]
    schema = "event_id int, model_id int, metric_name string, metric_value double, ts timestamp"
    df = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "event_id int, model_id int, metric_name string, metric_value double, s int")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source = tmp_path / "in"
    for part in range(3):  # three files in order of time, one batch each
        df.where(F.col("event_id").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(str(source))
    rules = A.rule_table(spark, [("r", "Rule", "m", ">", 0.3, "high", "t", 120.0, None)])
    want = {r["alert_id"] for r in A.evaluate_rules(df, rules).collect()}
    stream = streams.open_stream(spark, "parquet", schema, str(source), maxFilesPerTrigger="1")
    streams.run_rules(stream, rules, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["alert_id"] for r in spark.read.parquet(str(tmp_path / "out" / "alerts")).collect()}
    assert got == want and len(want) > 5


def test_fan_out_writes_enabled_targets_only(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = streams.open_stream(spark, "parquet", "id bigint", str(tmp_path / "in"))
    targets = [
        {"path": str(tmp_path / "a"), "format": "parquet", "enabled": True},
        {"path": str(tmp_path / "b"), "format": "json", "enabled": True},
        {"path": str(tmp_path / "c"), "enabled": False},
    ]
    streams.start(stream, str(tmp_path / "cp"), streams.fan_out(targets), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.json(str(tmp_path / "b")).count() == 10
    assert not (tmp_path / "c").exists()


def test_rejected_records_are_kept_aside(spark):
    df = spark.createDataFrame([(json.dumps({"k": 1, "v": 2.0}),), ('{"k": 1}',), ("{oops",)], "body string")
    checked = streams.validate_records(df, "body", "k bigint, v double", ["k", "v"])
    assert streams.valid_records(checked).count() == 1
    assert {r["error"] for r in streams.rejected_records(checked).collect()} == {"missing v", "malformed"}


# ------------------------------------------------------------------ windows


def test_sliding_count_against_a_loop(spark):
    rng = random.Random(5)
    seconds = sorted(rng.randrange(0, 2000) for _ in range(500))
    df = spark.createDataFrame([("k", s) for s in seconds], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["second"]: r["in_window"] for r in windows.sliding_request_count(df, "k", "ts", 60, 10, chunk=100).collect()}
    assert got == {s: sum(1 for o in seconds if s - 60 <= o <= s) for s in set(seconds)}


# ------------------------------------------------------------------ explanations


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=3)), int(rng.random() > 0.5)) for i in range(400)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int")


def test_attributions_add_up(people):
    scorer = scoring.ColumnScorer(lambda x: x["a"] * x["b"] + F.exp(x["c"]))
    background = E.background_rows(people, "id", ["a", "b", "c"], 8)
    rows = E.shap_kernel(people.limit(20), "id", ["a", "b", "c"], scorer, background)
    for r in rows.groupBy("id", "base", "prediction").agg(F.sum("attribution").alias("s")).collect():
        assert r["base"] + r["s"] == pytest.approx(r["prediction"])


def test_sampled_attributions_of_a_linear_score_are_exact(spark):
    names = [f"f{i}" for i in range(12)]
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=12))) for i in range(5)], "id int, " + ", ".join(f"{n} double" for n in names))
    weights = {n: float(i + 1) for i, n in enumerate(names)}
    background = [tuple(map(float, rng.normal(size=12))) for _ in range(3)]
    rows = E.shap_kernel(df, "id", names, scoring.linear_scorer(weights), background, permutations=4, method="permutation").collect()
    values = {(r["id"], n): r[n] for r in df.collect() for n in names}
    for r in rows:
        j = names.index(r["feature"])
        want = weights[r["feature"]] * (values[(r["id"], r["feature"])] - np.mean([b[j] for b in background]))
        assert r["attribution"] == pytest.approx(want)


def test_lime_recovers_a_linear_score(people):
    rows = E.lime_tabular(people.limit(5), "id", ["a", "b"], scoring.linear_scorer({"a": 2.0, "b": -1.0}), 200).collect()
    spread = people.limit(5).agg(F.stddev_pop("a").alias("a"), F.stddev_pop("b").alias("b")).first()
    for r in rows:
        assert r["coefficient"] == pytest.approx({"a": 2.0, "b": -1.0}[r["feature"]] * spread[r["feature"]], rel=1e-4)
        assert r["fit"] == pytest.approx(1.0, abs=1e-6)


def test_unused_feature_has_no_importance(people):
    scorer = scoring.linear_scorer({"a": 1.0}, 0.5)
    rows = {r["feature"]: r for r in E.permutation_importance(people.withColumn("y", (F.col("a") > 0).cast("int")), "id", ["a", "b"], "y", scorer, 3).collect()}
    assert rows["b"]["importance"] == 0.0
    assert rows["a"]["importance"] > 0.3


@pytest.mark.parametrize("ids", [[], [5], [1, 2, 3], list(range(300)), [7] * 40 + list(range(100, 130)) + [None]])
def test_successors_in_hash_order(spark, ids):
    """Against a loop, for tables shorter than the shift, one hot key, a null key, and another cut into ranges."""
    rows = [(k, float(i % 17) if i % 5 else None) for i, k in enumerate(ids)]
    digest = lambda k: hashlib.md5("|".join(["3"] + ([] if k is None else [str(k)])).encode()).hexdigest()
    order = sorted(rows, key=lambda r: (digest(r[0]), r[1] is not None, r[1] or 0.0))
    want = sorted((str(k), str(v), str([order[(i + s) % len(order)][1] for s in range(1, 5)])) for i, (k, v) in enumerate(order))
    df = spark.createDataFrame(rows, "k int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [(str(r["k"]), str(r["v"]), str([x[0] for x in r["_next"]])) for r in E.with_successors(df, "k", ["v"], 4, 3).collect()]
            assert sorted(got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tree_nodes_follow_the_model(people):
    scorer = scoring.ColumnScorer(lambda x: F.when((x["a"] > 0.2) & (x["b"] < 0.5), 0.9).otherwise(0.1))
    model, fidelity = E.surrogate_tree(people, ["a", "b", "c"], scorer, max_depth=3)
    assert fidelity.first()["fidelity"] > 0.95
    nodes = E.tree_nodes(model, ["a", "b", "c"])
    assert len(nodes) == model.numNodes
    assert max(n["depth"] for n in nodes) == model.depth
    leaves = {n["node_id"]: n["prediction"] for n in nodes if n["feature"] is None}
    both = scoring.score(people.withColumn("leaf", E.leaf_of(nodes)), scoring.ModelScorer(model, ["a", "b", "c"]), ["a", "b", "c"])
    assert all(leaves[r["leaf"]] == float(r["score"] >= 0.5) for r in both.collect())
    stats = {r["node_id"]: r["samples"] for r in E.node_stats(people, nodes, "y").collect()}
    assert stats[0] == 400 and sum(stats[i] for i in leaves) == 400


# ------------------------------------------------------------------ fairness, KPIs, preprocessing


def test_reweighed_label_rates_are_equal(spark):
    df = spark.createDataFrame([("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 5 + [("b", 0)] * 55, "g string, y int")
    rows = X.reweighing(df, "g").groupBy("g").agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("r")).collect()
    assert rows[0]["r"] == pytest.approx(rows[1]["r"]) == pytest.approx(0.35)


def test_calibration_fit_solves_its_equations(spark):
    rng = np.random.default_rng(9)
    p = rng.random(600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(3 * p - 1.5)))).astype(int)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(p, y)], "g string, p double, y int")
    row = X.calibration_fit(df, ["g"]).first()
    q = 1 / (1 + np.exp(-(row["calibration_slope"] * p + row["calibration_intercept"])))
    assert (y - q).sum() == pytest.approx(0, abs=1e-6)
    assert ((y - q) * p).sum() == pytest.approx(row["calibration_slope"], abs=1e-6)  # the penalty's pull


def test_formula_guard(spark):
    df = spark.createDataFrame([(1.0, "cost")], "value double, kind string")
    assert kpi.custom_metric(df, "sum(value) / nullif(count(value), 0)").first()["value"] == 1.0
    for bad in ("reflect('java.lang.System', 'exit')", "sum(secret)", "sum(value); drop table x"):
        with pytest.raises(ValueError):
            kpi.custom_metric(df, bad)


def test_ratios_must_add_up(spark):
    with pytest.raises(ValueError):
        preprocess.train_validation_test_split(spark.range(3), ["id"], 0.8, 0.3, 0.1)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "a double")
    assert Q.missing_counts(df).first()["missing"] == 2
    assert [r["a"] for r in preprocess.fill_missing(df, ["a"], "mean").collect()] == [2.0, 2.0, 2.0]


# ------------------------------------------------------------------ keys that are null, tied, large or shared


def test_rank_survives_ties_and_nulls(spark):
    rows = [("a", 5.0, i) for i in range(3000)] + [("a", None, 5000), ("b", None, 1), (None, 7.0, 2), ("a", 9.0, 9999)]
    got = {(r.k, r.t): r["rank"] for r in windows.rank_by(spark.createDataFrame(rows, "k string, v double, t int"), ["k"], "v", "t").collect()}
    assert len(got) == len(rows) and got[("a", 9999)] == 1 and got[("a", 0)] == 2 and got[("a", 2999)] == 3001
    assert got[("a", 5000)] == 3002 and got[("b", 1)] == 1 and got[(None, 2)] == 1
    nothing = spark.createDataFrame([("a", None, i) for i in range(10)], "k string, v double, t int")
    assert sorted(r["rank"] for r in windows.rank_by(nothing, ["k"], "v", "t").collect()) == list(range(1, 11))


def test_range_parts_are_even(spark):
    from tallywatch.operators import summaries as S

    values = spark.range(100_000).select(F.lit("f").alias("feature"), F.concat(F.lit("usr_"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("value"))
    sizes = [r["count"] for r in S.in_order(values, "feature", "value").groupBy("slot").count().collect()]
    assert max(sizes) < 4 * sum(sizes) / len(sizes)
    codes = S.ordered_codes(values).orderBy("value").select("code").limit(3).collect()
    assert [r["code"] for r in codes] == [0, 1, 2]


def test_slots_stay_even_beside_a_far_value(spark):
    from tallywatch.operators import summaries as S

    numbers = spark.range(200_000).select(F.lit("f").alias("feature"), F.when(F.col("id") == 7, 1e12).otherwise(F.rand(3)).alias("value"))
    sizes = [r["count"] for r in S.with_slot(numbers, S.slot_limits(numbers)).groupBy("slot").count().collect()]
    assert max(sizes) < 4 * sum(sizes) / len(sizes)


def test_position_split_in_the_key_s_own_type(spark):
    from tallywatch.operators import filters

    big = 1 << 60
    rows = filters.split_by_position(spark.createDataFrame([(big + i,) for i in range(10)], "k long"), "k", 0.7).collect()
    assert sorted(r.k - big for r in rows if r.side == "ref") == list(range(7))
    names = filters.split_by_position(spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string"), "k", 0.5).collect()
    assert {r.k: r.side for r in names} == {"a": "ref", "b": "ref", "c": "cur", None: "cur"}


def test_null_groups_keep_their_rows(spark):
    from tallywatch.operators import fairness, preprocess

    rows = spark.createDataFrame([(i, None if i % 4 == 0 else "ab"[i % 2], i % 3 % 2) for i in range(1000)], "id int, g string, y int")
    weighted = fairness.reweighing(rows, "g")
    assert weighted.count() == 1000 and weighted.where("weight IS NULL").count() == 0
    split = preprocess.stratified_split(rows, ["id"], "g", 0.2).where("g IS NULL").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 200, "test": 50}


def test_latest_of_a_tie_is_the_larger(spark):
    rows = spark.createDataFrame([("k", 1, 3.0), ("k", 1, 4.0), ("k", 0, 9.0)], "k string, ts int, v double")
    assert tuple(windows.latest_two(rows, ["k"], "ts", "v").first()) == ("k", 4.0, 3.0)


def test_drift_methods_are_checked(spark):
    from tallywatch.operators import drift

    sided = spark.createDataFrame([("ref", 1.0), ("cur", 2.0)], "side string, x double")
    assert drift.detect_drift(sided, ["x"], methods=["chi_square"]).count() == 0
    with pytest.raises(ValueError):
        drift.detect_drift(sided, ["x"], methods=["no_such_method"])


def test_kernel_discrepancy_takes_all_rows(spark):
    from tallywatch.operators import drift

    rng = np.random.default_rng(5)
    ref, cur = rng.normal(0, 2, 1600), np.concatenate([rng.normal(0.5, 2, 1400), [1e9]])
    long_df = spark.createDataFrame([("ref", "x", float(v)) for v in ref] + [("cur", "x", float(v)) for v in cur], "side string, feature string, value double")
    kernel = lambda a, b, g: np.exp(-g * (a[:, None] - b[None, :]) ** 2).mean()
    for gamma in (1.0, 0.3):
        want = kernel(ref, ref, gamma) + kernel(cur, cur, gamma) - 2 * kernel(ref, cur, gamma)
        assert abs(drift.mmd(long_df, gamma).first()["mmd"] - want) < 1e-9


@pytest.mark.parametrize("name", ["counterfactuals", "lime", "ice", "shap", "pdp"])
def test_expanded_rows_are_dealt_out(spark, name):
    """One input split is no one task: the scorer says in which partition a row was scored."""
    rows = spark.createDataFrame([(i, float(i % 7 + 1), float(i % 5)) for i in range(64)], "id int, a double, b double").coalesce(1)
    where = scoring.ColumnScorer(lambda x: F.spark_partition_id() + x["a"] * 0)
    found = {
        "counterfactuals": lambda: E.counterfactuals(rows, "id", ["a", "b"], where, candidates=4).select("prediction"),
        "lime": lambda: E.lime_tabular(rows, "id", ["a", "b"], where, num_samples=20).select(F.round("intercept")),
        "ice": lambda: E.ice_curves(rows, "id", ["a", "b"], where, points=3).select("prediction"),
        "shap": lambda: E.shap_kernel(rows, "id", ["a", "b"], where, [(1.0, 1.0)]).select(F.round("prediction")),
        "pdp": lambda: E.partial_dependence(rows, ["a", "b"], where, 2).select(F.explode(F.array(F.lit(0.0), "mean_prediction"))),
    }[name]().distinct().collect()
    assert len(found) > 1


def test_stratified_rows_stay_where_they_are(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "int(id % 2) AS y", "double(id % 13) AS a")
    split = preprocess.stratified_split(rows, ["id"], "y", 0.2)
    assert split.select(F.spark_partition_id()).distinct().count() == 8
    assert sorted(r["count"] for r in split.groupBy("y", "split").count().collect()) == [400, 400, 1600, 1600]


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest"])
def test_baselines_are_fitted_on_rows_dealt_out(spark, monkeypatch, kind):
    """The rows of one input split or one label are no one task."""
    from pyspark.ml.base import Estimator

    seen, fit = [], Estimator.fit
    monkeypatch.setattr(Estimator, "fit", lambda self, rows: (seen.append(rows), fit(self, rows))[1])
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "int(id % 3 = 0) AS y", "double(id % 13) AS a", "'g' AS g")
    _, scored = X.baseline_model(rows, ["a"], ["id"], kind)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and sum(sizes) + scored.count() == 400 and max(sizes) < 100


def _counted(spark, n):
    """(rows of both sides, how often one was worked out)."""
    count = spark.sparkContext.accumulator(0)

    def touch(i):
        count.add(1)
        return float(i % 97)

    x = F.udf(touch, "double")("id")
    return spark.range(0, n, 1, 2).select(F.when(F.col("id") % 2 == 0, "ref").otherwise("cur").alias("side"), x.alias("x")), count


def test_adversarial_accuracy_reads_its_source_once(spark):
    from tallywatch.operators import drift

    sided, count = _counted(spark, 600)
    assert 0 <= drift.adversarial_accuracy(sided, ["x"]).first()["auc"] <= 1
    assert count.value == 600


def test_kernel_of_a_report_comes_from_the_value_counts(spark):
    from tallywatch.operators import drift

    sided, count = _counted(spark, 600)
    drift.detect_drift(sided, ["x"], methods=["maximum_mean_discrepancy", "wasserstein"]).collect()
    assert count.value == 600


def test_kernel_of_counts_is_that_of_rows(spark):
    """Values on one side only, and values that repeat."""
    from tallywatch.operators import drift

    rows = [("ref", "x", float(v)) for v in (0, 0, 0, 1, 2.5, 7)] + [("cur", "x", float(v)) for v in (0, 1, 1, 9, 9)]
    a, b = (np.array([v for s, _, v in rows if s == side]) for side in ("ref", "cur"))
    kernel = lambda a, b: np.exp(-(a[:, None] - b[None, :]) ** 2).mean()
    long_df = spark.createDataFrame(rows, "side string, feature string, value double")
    counts = long_df.groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("c_ref"), F.count_if(F.col("side") == "cur").alias("c_cur"))
    got = drift.mmd_of_counts(counts).first()["mmd"]
    assert abs(got - (kernel(a, a) + kernel(b, b) - 2 * kernel(a, b))) < 1e-9


@pytest.mark.parametrize("ids", [[], [5], list(range(300)), [7] * 40 + list(range(100, 130)) + [None]])
def test_every_repeat_is_a_shuffle_of_its_own(spark, ids):
    """Against a loop: not one order shifted, and the same however the orders are cut."""
    rows = [(k, float(i % 17) if i % 5 else None) for i, k in enumerate(ids)]
    want = []
    for r in range(3):
        digest = lambda k, r=r: hashlib.md5("|".join(["3", str(r)] + ([] if k is None else [str(k)])).encode()).hexdigest()
        order = sorted(rows, key=lambda x: (digest(x[0]), x[1] is not None, x[1] or 0.0))
        want += [(r, str(k), str(v), str(order[(i + 1) % len(order)][1])) for i, (k, v) in enumerate(order)]
    df = spark.createDataFrame(rows, "k int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [(r["_repeat"], str(r["k"]), str(r["v"]), str(r["_vec"][0])) for r in E.with_shuffles(df, "k", ["v"], 3, 3).collect()]
            assert sorted(got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
