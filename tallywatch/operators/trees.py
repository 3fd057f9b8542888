"""Fitted trees as flat node tables, and exact Shapley values read off their leaves.

A node is {node_id, parent_id, depth, feature, threshold, categories, side, prediction, value, cover}: rows go left where the
feature is at most the threshold, or among the categories; ``value`` is what the node alone would predict and
``cover`` the number of training rows that reached it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallywatch.operators import summaries as S
from tallywatch.session import shared_folder


def saved_nodes(model, features: Sequence[str]) -> list[tuple[float, list[dict]]]:
    """(weight, nodes) of every tree of a fitted MLlib tree, forest or boosted model.

    The model is saved to the shared folder and its node table read back with Spark. Values are the
    probability of class 1 for trees that classify, averaged over a forest, and predictions else; their weighted
    sum over trees is the model's probability, prediction or, for boosted classifiers, margin.
    """
    from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel

    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
        count = model.getNumTrees
        weights = [w / count if isinstance(model, RandomForestClassificationModel) or not _boosted(model) else w for w in model.treeWeights]
    else:
        rows, weights = rows.withColumn("treeID", F.lit(0)), [1.0]
    stats = F.col("impurityStats")
    classes = isinstance(model, (DecisionTreeClassificationModel, RandomForestClassificationModel))
    value = F.get(stats, 1) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if classes else F.col("prediction")
    trees: dict[int, dict[int, dict]] = {}
    # A model's nodes fit the driver, as the model does.
    for r in rows.select("*", value.alias("value")).collect():
        split, inner = r["split"], r["leftChild"] >= 0
        limits = list(split["leftCategoriesOrThreshold"])
        threshold = inner and split["numCategories"] == -1
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "node_id": r["id"], "parent_id": None, "depth": 0, "feature": features[split["featureIndex"]] if inner else None,
            "threshold": limits[0] if threshold else None, "categories": limits if inner and not threshold else None, "side": None,
            "prediction": None if inner else r["prediction"], "value": r["value"], "cover": float(r["rawCount"]), "kids": (r["leftChild"], r["rightChild"]),
        }
    out = []
    for tree in sorted(trees):
        nodes = trees[tree]
        for i in sorted(nodes):  # numbered in pre-order: parents come first
            kids = nodes[i].pop("kids")
            for side, kid in zip(("left", "right"), kids):
                if kid >= 0:
                    nodes[kid].update(parent_id=i, side=side, depth=nodes[i]["depth"] + 1)
        out.append((float(weights[tree]), [nodes[i] for i in sorted(nodes)]))
    return out


def _boosted(model) -> bool:
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import GBTRegressionModel

    return isinstance(model, (GBTClassificationModel, GBTRegressionModel))


def goes_left(node: dict) -> Column:
    """Whether a row takes the left way at a split; missing values go right."""
    column = F.col(node["feature"])
    left = column.isin(node["categories"]) if node.get("categories") is not None else column <= node["threshold"]
    return F.coalesce(left, F.lit(False))


def with_covers(df: DataFrame, nodes: Sequence[dict], label: str) -> list[dict]:
    """``nodes`` with ``cover`` and ``value`` from a table: rows, and the mean of ``label``, at every node."""
    from tallywatch.operators.explain import leaf_of

    table = {r["leaf"]: (r["n"], r["s"]) for r in df.groupBy(leaf_of(nodes).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s")).collect()}
    by_id = {n["node_id"]: dict(n, cover=0.0, value=0.0) for n in nodes}
    for leaf, (n, s) in table.items():
        at = leaf
        while at is not None:
            by_id[at]["cover"] += n
            by_id[at]["value"] += s or 0.0
            at = by_id[at]["parent_id"]
    for node in by_id.values():
        node["value"] = node["value"] / node["cover"] if node["cover"] else 0.0
    return [by_id[n["node_id"]] for n in nodes]


def flat_leaves(trees: Sequence[tuple[float, Sequence[dict]]], features: Sequence[str]):
    """(splits, leaves): splits are (feature, threshold, categories); a leaf is (weighted value, its features, per feature the
    share of rows its splits let pass, per feature its splits and the side they must go)."""
    splits, leaves = [], []
    for weight, nodes in trees:
        by_id = {n["node_id"]: n for n in nodes}
        number = {}
        for n in nodes:
            if n["feature"] is not None:
                number[n["node_id"]] = len(splits)
                splits.append((features.index(n["feature"]), n["threshold"], n.get("categories")))
        kids = {}
        for n in nodes:
            kids.setdefault(n["parent_id"], []).append(n["node_id"])
        for n in nodes:
            if n["feature"] is not None:
                continue
            shares: dict[int, float] = {}
            ways: dict[int, list[tuple[int, bool]]] = {}
            at = n
            while at["parent_id"] is not None:
                parent = by_id[at["parent_id"]]
                j = features.index(parent["feature"])
                # A split that no row reached shares evenly.
                passed = at["cover"] / parent["cover"] if parent["cover"] else 1.0 / len(kids[parent["node_id"]])
                shares[j] = shares.get(j, 1.0) * passed
                ways.setdefault(j, []).append((number[parent["node_id"]], at["side"] == "left"))
                at = parent
            own = sorted(shares)
            leaves.append((weight * n["value"], own, [shares[j] for j in own], [ways[j] for j in own]))
    return splits, leaves


def leaf_weights(met, shares):
    """Weights of a leaf's features, for rows of ``met`` (rows x features, whether the row meets the leaf's splits on a feature).

    The weight of feature j sums, over all sets S of the other features, |S|! (d - |S| - 1)! / d! times the share of rows that reach
    the leaf when S is known. The sums of all sets of a size are the coefficients of the product of (share + met t)
    over the features; one feature is taken out of the product by division.
    """
    import numpy as np

    u, d = met.shape
    product = np.zeros((u, d + 1))
    product[:, 0] = 1.0
    for k in range(d):
        grown = product * shares[k]
        grown[:, 1:] += product[:, :-1] * met[:, k : k + 1]
        product = grown
    by_size = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
    out = np.zeros((u, d))
    for j in range(d):
        others = np.zeros((u, d))
        on = met[:, j] == 1
        carry = product[on, d]
        for s in range(d - 1, -1, -1):
            others[on, s] = carry
            carry = product[on, s] - shares[j] * carry
        if shares[j] > 0:
            others[~on] = product[~on, :d] / shares[j]
        elif (~on).any():
            rest = [k for k in range(d) if k != j]
            alone = np.zeros((int((~on).sum()), d))
            alone[:, 0] = 1.0
            for k in rest:
                grown = alone * shares[k]
                grown[:, 1:] += alone[:, :-1] * met[~on, k : k + 1]
                alone = grown
            others[~on] = alone
        out[:, j] = others @ by_size
    return out


def tree_shap(df: DataFrame, key: str, features: Sequence[str], trees: Sequence[tuple[float, Sequence[dict]]]) -> DataFrame:
    """(key, base, prediction, feature, attribution): exact Shapley values of a sum of trees, features left out averaged by cover.

    Linear in rows and leaves and quadratic in the depth of a leaf, however many features there are. Rows that meet the same
    splits of a leaf share its weights. ``base`` is the mean over covers, and base plus all attributions is the prediction.
    """
    import pyarrow as pa

    features = list(features)
    splits, leaves = flat_leaves(trees, features)
    kind = df.schema[key].dataType
    out_schema = StructType([StructField("_key", kind), StructField("base", DoubleType()), StructField("prediction", DoubleType()), StructField("_phi", ArrayType(DoubleType()))])

    def explain(batches):
        import numpy as np

        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))]) if batch.num_rows else np.zeros((0, len(features)))
            left = [np.isin(x[:, j], categories) if categories is not None else x[:, j] <= threshold for j, threshold, categories in splits]
            phi, base, prediction = np.zeros(x.shape), 0.0, np.zeros(len(x))
            for value, own, shares, ways in leaves:
                base += value * math.prod(shares)
                met = np.zeros((len(x), len(own)))
                code = np.zeros(len(x), np.int64)
                for k, way in enumerate(ways):
                    fits = np.ones(len(x), bool)
                    for split, side in way:
                        fits &= left[split] == side
                    met[:, k] = fits
                    code |= fits.astype(np.int64) << k
                _, first, same = np.unique(code, return_index=True, return_inverse=True)
                if len(own):
                    some = met[first]
                    parts = value * (some - np.array(shares)) * leaf_weights(some, shares)
                    phi[:, own] += parts[same]
                prediction += value * met.all(1)
            rows = pa.array(phi.ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), pa.array(prediction), pa.ListArray.from_arrays(offsets, rows)], ["_key", "base", "prediction", "_phi"])

    rows = df.select(F.col(key).alias("_key"), *[S.clean(f).cast("double").alias(f) for f in features]).mapInArrow(explain, out_schema)
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("_phi").alias("attribution"))
    return rows.select(F.col("_key").alias(key), "base", "prediction", F.inline(named)).toDF(key, "base", "prediction", "feature", "attribution")
