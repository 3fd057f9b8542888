"""Shapley values of trees against all coalitions in plain Python, and node tables of fitted models."""

import itertools
import math
import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tallywatch.operators import explain, trees


def grown(rng, features, depth, node=0, parent=None, side=None, level=0, cover=1000.0, out=None):
    """A random tree in which a feature may come back below itself."""
    out = [] if out is None else out
    leaf = level == depth or rng.random() < 0.15 and level > 1
    me = {"node_id": len(out), "parent_id": parent, "depth": level, "feature": None if leaf else rng.choice(features), "threshold": None, "categories": None, "side": side,
          "prediction": rng.random() if leaf else None, "value": rng.uniform(-1, 1), "cover": cover}
    out.append(me)
    if not leaf:
        if rng.random() < 0.3:
            me["categories"] = rng.sample([0.0, 1.0, 2.0, 3.0], 2)
        else:
            me["threshold"] = rng.choice([0.5, 1.5, 2.5])
        share = rng.choice([0.25, 0.5, 0.0 if level > 1 else 0.75])
        grown(rng, features, depth, parent=me["node_id"], side="left", level=level + 1, cover=cover * share, out=out)
        grown(rng, features, depth, parent=me["node_id"], side="right", level=level + 1, cover=cover * (1 - share), out=out)
    return out


def expected(nodes, row, known, at=0):
    n = nodes[at]
    if n["feature"] is None:
        return n["value"]
    left, right = (next(m for m in nodes if m["parent_id"] == at and m["side"] == s) for s in ("left", "right"))
    if n["feature"] in known:
        x = row[n["feature"]]
        goes = x is not None and (x in n["categories"] if n["categories"] else x <= n["threshold"])
        return expected(nodes, row, known, (left if goes else right)["node_id"])
    share = left["cover"] / n["cover"] if n["cover"] else 0.5
    return share * expected(nodes, row, known, left["node_id"]) + (1 - share) * expected(nodes, row, known, right["node_id"])


def brute(forest, row, features):
    def value(known):
        return sum(w * expected(nodes, row, known) for w, nodes in forest)

    out = {}
    for f in features:
        others = [g for g in features if g != f]
        out[f] = sum(
            math.factorial(k) * math.factorial(len(features) - k - 1) / math.factorial(len(features)) * (value({*s, f}) - value(set(s)))
            for k in range(len(others) + 1)
            for s in itertools.combinations(others, k)
        )
    return out, value(set()), value(set(features))


@pytest.mark.parametrize("seed", range(4))
def test_against_all_coalitions(spark, seed):
    rng = random.Random(seed)
    features = ["a", "b", "c", "d", "e"]
    forest = [(rng.choice([1.0, -0.5]), grown(rng, features, 5)) for _ in range(3)]
    rows = [(i, *[rng.choice([0.0, 1.0, 2.0, 3.0, None]) for _ in features]) for i in range(12)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double, e double")
    got = {}
    for r in trees.tree_shap(df, "key", features, forest).collect():
        got.setdefault(r.key, ({}, r.base, r.prediction))[0][r.feature] = r.attribution
    for key, *values in rows:
        want, base, prediction = brute(forest, dict(zip(features, values)), features)
        assert got[key][1] == pytest.approx(base) and got[key][2] == pytest.approx(prediction)
        assert got[key][0] == pytest.approx(want, abs=1e-12)
    assert trees.tree_shap(df.limit(0), "key", features, forest).count() == 0


def test_twenty_five_features(spark):
    # One long way down: every feature is asked once. 2^25 coalitions are out of reach, the symmetric case is not.
    features = [f"f{i}" for i in range(25)]
    nodes = []
    for i, f in enumerate(features):
        top = {"node_id": 2 * i, "parent_id": 2 * i - 2 if i else None, "depth": i, "feature": f, "threshold": 0.5, "categories": None, "side": "right" if i else None, "prediction": None, "value": 0.0, "cover": 2.0**-i}
        nodes += [top, {**top, "node_id": 2 * i + 1, "parent_id": 2 * i, "depth": i + 1, "feature": None, "side": "left", "prediction": 0.0, "cover": 2.0 ** -(i + 1)}]
    nodes.append({"node_id": 50, "parent_id": 48, "depth": 25, "feature": None, "threshold": None, "categories": None, "side": "right", "prediction": 1.0, "value": 1.0, "cover": 2.0**-25})
    df = spark.createDataFrame([(1, *[1.0] * 25), (2, *[1.0] * 24, 0.0)], "key long, " + ", ".join(f"{f} double" for f in features))
    rows = trees.tree_shap(df, "key", features, [(1.0, nodes)]).collect()
    base = 2.0**-25
    for r in rows:
        assert r.base == pytest.approx(base)
        if r.key == 1:
            assert r.attribution == pytest.approx((1 - base) / 25)
    second = [r.attribution for r in rows if r.key == 2]
    assert sum(second) + base == pytest.approx(0.0, abs=1e-9) and min(second) == second[24] < 0


MAKERS = {
    "tree": lambda: DecisionTreeClassifier(maxDepth=4),
    "forest": lambda: RandomForestClassifier(numTrees=5, maxDepth=3, seed=1),
    "boosted": lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1),
    "boosted_regressor": lambda: GBTRegressor(maxIter=3, maxDepth=3, seed=1),
}


@pytest.mark.parametrize("kind", MAKERS)
def test_fitted_models_add_up(spark, kind):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.sin("id").alias("c"))
    df = df.withColumn("label", (((F.col("a") > 3).cast("int") != F.col("b").isin(1, 3).cast("int")) | (F.col("c") > 0.9)).cast("double"))
    nominal = df.withColumn("b", explain._nominal("b", 5))
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(nominal)
    model = MAKERS[kind]().fit(vectors)
    forest = trees.saved_nodes(model, ["a", "b", "c"])
    assert any(n["categories"] for _, nodes in forest for n in nodes)
    scored = model.transform(vectors)
    if kind == "boosted":
        want = vector_to_array("rawPrediction")[1]
    elif "probability" in scored.columns:
        want = vector_to_array("probability")[1]
    else:
        want = F.col("prediction")
    want = {r.id: r.w for r in scored.select("id", want.alias("w")).collect()}
    total = {}
    for r in trees.tree_shap(df, "id", ["a", "b", "c"], forest).collect():
        total.setdefault(r.id, [r.base, r.prediction])[0] += r.attribution
    for i, (summed, prediction) in total.items():
        assert summed == pytest.approx(prediction, abs=1e-9)
        assert prediction == pytest.approx(want[i], abs=1e-9)
    assert sum(n["cover"] for n in forest[0][1] if n["feature"] is None) == forest[0][1][0]["cover"]


def test_rules_name_categories():
    nodes = [
        {"node_id": 0, "parent_id": None, "depth": 0, "feature": "b", "threshold": None, "categories": [1.0, 3.0], "side": None, "prediction": None},
        {"node_id": 1, "parent_id": 0, "depth": 1, "feature": None, "threshold": None, "categories": None, "side": "left", "prediction": 1.0},
        {"node_id": 2, "parent_id": 0, "depth": 1, "feature": None, "threshold": None, "categories": None, "side": "right", "prediction": 0.0},
    ]
    assert explain._paths(nodes) == {0: [], 1: ["b in {1, 3}"], 2: ["b not in {1, 3}"]}
