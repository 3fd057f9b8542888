"""Explanations: perturb rows, score them, aggregate.

Grids, coalitions and repeats are generated inside each row. Rows that are expanded are first dealt
out evenly, as a few megabytes of them can be hours of work; else only partly aggregated results move.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tallywatch.functions.bands import interval_bin, linspace
from tallywatch.operators import summaries as S
from tallywatch.operators.scoring import Scorer, own_inputs, score
from tallywatch.operators.trees import goes_left, saved_nodes
from tallywatch.session import local_table, materialise



def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with costly columns, each worked out once per row.

    Filters and projections that use a plain column get copies of its expression; a generated one stands for itself.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# ---------------------------------------------------------------- permutation


def _hash(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def with_successors(df: DataFrame, key: str, columns: Sequence[str], n: int, seed: int) -> DataFrame:
    """``df`` with ``_next``: the values of ``columns`` in the ``n`` rows that follow in hash order.

    The order is that of a hash of ``key`` over the whole table, ties by the values; the first rows
    follow the last one. Handing every row the values of its s-th successor is a random shuffle without
    fixed rows (if there are more than s), another one for every s.

    Rows move once, into ranges of the hash. How many ranges there are steers the spread of the work
    only: the rows that follow a range are looked up among the first ``n`` rows of the later ranges.
    ``df`` must be deterministic, as it is read twice. An empty table stays empty.
    """
    spark = df.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
    rows = df.withColumns({"_h": _hash(seed, key), "_vec": F.array(*columns)}).withColumn(
        "_slot", F.shiftright(place * ranges, 32).cast("int")
    )
    inside = Window.partitionBy("_slot").orderBy("_h", "_vec")
    heads = materialise(
        rows.select("_slot", "_h", "_vec").withColumn("_i", F.row_number().over(inside)).where(F.col("_i") <= n)
    ).select("_slot", "_i", "_vec")
    # Two numbers per range: their count follows the setting above, not the table.
    sizes = sorted(heads.groupBy("_slot").agg(F.max("_i").alias("n")).collect())
    order = [(r["_slot"], i + 1) for r in sizes for i in range(r["n"])]
    wanted, end = [], 0
    for r in sizes:
        end += r["n"]
        wanted += [(r["_slot"], j, *order[(end + j) % len(order)]) for j in range(n)]
    sources = local_table(spark, wanted, "_for int, _j int, _slot int, _i int")
    after = (
        heads.join(F.broadcast(sources), ["_slot", "_i"])
        .groupBy(F.col("_for").alias("_slot"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_vec"))), lambda x: x["_vec"]).alias("_after"))
    )
    placed = rows.withColumns(
        {
            "_left": F.count(F.lit(1)).over(Window.partitionBy("_slot")) - F.row_number().over(inside),
            "_ahead": F.array(*[F.lead("_vec", s).over(inside) for s in range(1, n + 1)]),
        }
    )
    left = F.col("_left").cast("int")
    follow = F.when(left >= n, F.col("_ahead")).otherwise(
        F.concat(F.slice("_ahead", F.lit(1), left), F.slice("_after", F.lit(1), F.lit(n) - left))
    )
    return placed.join(after, "_slot").withColumn("_next", follow).select(*df.columns, "_next")


def with_shuffles(df: DataFrame, key: str, columns: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """``df`` ``repeats`` times, with ``_repeat`` and ``_vec``: the values of ``columns`` in the next row of a hash order.

    Every repeat has a hash order of its own over the whole table, ties by the values; the first row follows the last one.
    Orders are cut into ranges of the hash, whose number steers the spread of the work only: the row that follows a
    range is the first of the next range with rows. ``df`` must be deterministic, as it is read twice.
    """
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
    rows = (
        S.spread_out(df)
        .withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumns({"_h": _hash(seed, "_repeat", key), "_own": F.array(*columns)})
        .withColumn("_slot", F.shiftright(place * ranges, 32).cast("int"))
    )
    inside = Window.partitionBy("_repeat", "_slot").orderBy("_h", "_own")
    first = rows.select("_repeat", "_slot", "_h", "_own").withColumn("_i", F.row_number().over(inside)).where("_i = 1")
    # One row per repeat and range.
    heads = Window.partitionBy("_repeat").orderBy("_slot")
    after = materialise(
        first.select("_repeat", "_slot", F.coalesce(F.lead("_own").over(heads), F.first("_own").over(heads)).alias("_after"))
    )
    placed = rows.withColumn("_next", F.lead("_own").over(inside))
    return placed.join(F.broadcast(after), ["_repeat", "_slot"]).select(
        *df.columns, "_repeat", F.coalesce("_next", "_after").alias("_vec")
    )


def _lost_accuracy(moved: DataFrame, features: Sequence[str], label: str, scorer: Scorer, cutoff: float) -> DataFrame:
    """(feature, importance, spread) from rows with ``_base``, a ``_repeat`` and the values ``_vec`` they get in it."""
    scored = moved
    for i, f in enumerate(features):
        scored = scorer.add(scored, own_inputs(features) | {f: F.get("_vec", F.lit(i))}, f"_s_{f}")

    def right(c: str) -> Column:
        return F.avg(((F.col(c) >= cutoff) == (F.col(label) == 1)).cast("double"))

    by_repeat = scored.groupBy("_repeat").agg(*[(right("_base") - right(f"_s_{f}")).alias(f) for f in features])
    long_df = by_repeat.unpivot(["_repeat"], list(features), "feature", "drop")
    return long_df.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("spread"))


def permutation_importance(
    df: DataFrame, key: str, features: Sequence[str], label: str, scorer: Scorer, repeats: int = 10, seed: int = 42,
    cutoff: float = 0.5,
) -> DataFrame:
    """(feature, importance, spread): loss of accuracy when a feature is shuffled, mean of the repeats.

    Every repeat is a shuffle of its own over the whole table (``with_shuffles``), which serves all features.
    """
    rows = df.select(key, label, *[S.clean(f).alias(f) for f in features])
    moved = scorer.add(with_shuffles(rows, key, features, repeats, seed), own_inputs(features), "_base")
    return _lost_accuracy(moved, features, label, scorer, cutoff)


def drop_column_importance(
    df: DataFrame, key: str, features: Sequence[str], label: str, scorer: Scorer, repeats: int = 10, seed: int = 42,
    cutoff: float = 0.5,
) -> DataFrame:
    """(feature, importance, spread) like ``permutation_importance``, from one hash order.

    Repeat s hands every row the values of its s-th successor in hash order (``with_successors``). One
    shuffle serves all features and all repeats.
    """
    rows = df.select(key, label, *[S.clean(f).alias(f) for f in features])
    based = scorer.add(with_successors(rows, key, features, repeats, seed), own_inputs(features), "_base")
    return _lost_accuracy(based.select("*", F.posexplode("_next").alias("_repeat", "_vec")), features, label, scorer, cutoff)


def interaction_matrix(
    df: DataFrame, key: str, features: Sequence[str], scorer: Scorer, seed: int = 42
) -> DataFrame:
    """(feature_i, feature_j, strength): mean absolute change when both are shuffled, minus each alone.

    The s-th feature takes the values of the s-th successor in hash order (``with_successors``), so every
    feature has a shuffle of its own and rows move once for all of them.
    """
    rows = df.select(key, *[S.clean(f).alias(f) for f in features])
    wide = with_successors(rows, key, features, len(features), seed)
    base = own_inputs(features)
    moved = {f: F.get(F.get("_next", F.lit(i)), F.lit(i)) for i, f in enumerate(features)}
    scored = scorer.add(wide, base, "_base")
    for f in features:
        scored = scorer.add(scored, base | {f: moved[f]}, f"_one_{f}")
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    for a, b in pairs:
        scored = scorer.add(scored, base | {a: moved[a], b: moved[b]}, f"_two_{a}_{b}")
    gap = lambda c: F.avg(F.abs(F.col("_base") - F.col(c)))
    one_row = scored.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"),
                    (gap(f"_two_{a}_{b}") - gap(f"_one_{a}") - gap(f"_one_{b}")).alias("strength"),
                )
                for a, b in pairs
            ]
        ).alias("r")
    )
    return one_row.select(F.inline("r"))


def interaction_summary(pairs: DataFrame, strong: float = 0.5) -> DataFrame:
    """Mean, largest and count of strong interactions over all pairs."""
    size = F.abs("strength")
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(size).alias("mean_strength"),
        F.max(size).alias("max_strength"),
        F.count_if(size > strong).alias("strong_pairs"),
        F.max_by(F.concat_ws("*", "feature_i", "feature_j"), size).alias("strongest"),
    )


def interaction_type(strength: Column) -> Column:
    return F.when(strength > 0, "synergistic").when(strength < 0, "redundant").otherwise("none")


# ---------------------------------------------------------------- attributions


def shap_linear(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, feature, value, attribution) with attribution = weight * (x - mean)."""
    means = df.agg(*[F.avg(S.clean(f)).alias(f) for f in weights]).first()
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), S.clean(f).alias("value"), (F.lit(float(w)) * (S.clean(f) - F.lit(means[f]))).alias("attribution"))
            for f, w in weights.items()
        ]
    )
    return df.select(key, F.inline(cells))


def background_rows(df: DataFrame, key: str, features: Sequence[str], n: int = 20, seed: int = 42) -> list[tuple]:
    """``n`` rows picked by hash: the reference set attributions compare with, held in the plan."""
    picked = S.top_rows(
        df.select(F.lit(1).alias("_all"), key, *[S.clean(f).alias(f) for f in features]).withColumn("_h", _hash(seed, key)),
        ["_all"], [F.col("_h")], n,
    )
    return [tuple(r[f] for f in features) for r in picked.orderBy("_h").collect()]


def _with_background(df: DataFrame, features: Sequence[str], background: Sequence[tuple]) -> DataFrame:
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in background])
    return df.withColumn("_bg", F.explode(rows))


def _bit(mask: Column, j: int) -> Column:
    return F.getbit(mask, F.lit(j)) == 1


def shap_kernel(
    df: DataFrame, key: str, features: Sequence[str], scorer: Scorer, background: Sequence[tuple], permutations: int = 64,
    seed: int = 42, method: str = "exact",
) -> DataFrame:
    """(key, feature, attribution, base, prediction): Shapley values against a background.

    ``method`` "exact" scores every coalition, 2^features per row; "permutation" those along ``permutations`` seeded
    feature orders. Coalitions and background rows are generated per row and summed before the shuffle.
    """
    m, b = len(features), len(background)
    rows = S.spread_out(df.select(key, *[S.clean(f).alias(f) for f in features]))
    if method not in ("exact", "permutation"):
        raise ValueError(f"no such method: {method}")
    if method == "exact":
        rows = rows.withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1))))
        inside = [_bit(F.col("_mask"), j) for j in range(m)]
        size = F.bit_count("_mask")
        joins = F.array(*[F.lit(math.factorial(max(s - 1, 0)) * math.factorial(m - max(s, 1)) / math.factorial(m)) for s in range(m + 1)])
        stays = F.array(*[F.lit(math.factorial(min(s, m - 1)) * math.factorial(m - min(s, m - 1) - 1) / math.factorial(m)) for s in range(m + 1)])
        weight = [F.when(inside[j], F.get(joins, size)).otherwise(-F.get(stays, size)) for j in range(m)]
        empty, full = F.col("_mask") == 0, F.col("_mask") == 2**m - 1
        runs = 1
    else:
        rng = random.Random(seed)
        orders = [rng.sample(range(m), m) for _ in range(permutations)]
        ranks = F.array(*[F.array(*[F.lit(o.index(j) + 1) for j in range(m)]) for o in orders])
        rows = rows.withColumn("_rank", F.explode(ranks)).withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(m))))
        place = [F.get(F.col("_rank"), j) for j in range(m)]
        inside = [place[j] <= F.col("_mask") for j in range(m)]
        weight = [
            F.when(place[j] == F.col("_mask"), 1.0).when(place[j] == F.col("_mask") + 1, -1.0).otherwise(0.0) for j in range(m)
        ]
        empty, full = F.col("_mask") == 0, F.col("_mask") == m
        runs = permutations
    rows = _with_background(rows, features, background)
    inputs = {f: F.when(inside[j], F.col(f)).otherwise(F.get(F.col("_bg"), j)) for j, f in enumerate(features)}
    scored = scorer.add(rows, inputs, "_f")
    scale = float(b * runs)
    sums = scored.groupBy(key).agg(
        (F.sum(F.when(empty, F.col("_f"))) / scale).alias("base"),
        (F.sum(F.when(full, F.col("_f"))) / scale).alias("prediction"),
        *[(F.sum(weight[j] * F.col("_f")) / scale).alias(f) for j, f in enumerate(features)],
    )
    return sums.unpivot([key, "base", "prediction"], list(features), "feature", "attribution")


def shap_interactions(df: DataFrame, key: str, features: Sequence[str], scorer: Scorer, background: Sequence[tuple]) -> DataFrame:
    """(feature_i, feature_j, strength): mean absolute pairwise Shapley interaction over all 2^features coalitions."""
    m, b = len(features), len(background)
    rows = S.spread_out(df.select(key, *[S.clean(f).alias(f) for f in features])).withColumn(
        "_mask", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1)))
    )
    rows = _with_background(rows, features, background)
    inside = [_bit(F.col("_mask"), j) for j in range(m)]
    inputs = {f: F.when(inside[j], F.col(f)).otherwise(F.get(F.col("_bg"), j)) for j, f in enumerate(features)}
    scored = scorer.add(rows, inputs, "_f")
    table = F.array(*[F.lit(math.factorial(s) * math.factorial(m - s - 2) / (2 * math.factorial(m - 1))) for s in range(m - 1)])
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]

    def weight(i: int, j: int) -> Column:
        others = F.bit_count("_mask") - inside[i].cast("int") - inside[j].cast("int")
        return F.get(table, others) * F.when(inside[i] == inside[j], 1.0).otherwise(-1.0)

    per_row = scored.groupBy(key).agg(*[(F.sum(weight(i, j) * F.col("_f")) / float(b)).alias(f"_{i}_{j}") for i, j in pairs])
    one_row = per_row.agg(
        F.array(
            *[
                F.struct(F.lit(features[i]).alias("feature_i"), F.lit(features[j]).alias("feature_j"), F.avg(F.abs(f"_{i}_{j}")).alias("strength"))
                for i, j in pairs
            ]
        ).alias("r")
    )
    return one_row.select(F.inline("r"))


def _normal(seed: int, *parts: str) -> Column:
    """A repeatable standard normal number per key (Box-Muller on two hash numbers)."""
    columns = [F.col(p) for p in parts]
    u1 = F.greatest(S.hash_unit(f"{seed}a", *columns), F.lit(1e-12))
    u2 = S.hash_unit(f"{seed}b", *columns)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(sums, width):  # pragma: no cover - runs in the worker
    """Weighted least squares per row from its packed normal equations: coefficients, then R2."""
    import numpy as np
    import pandas as pd

    out = []
    for packed, k in zip(sums, width):
        v, k = np.asarray(packed, dtype=float), int(k)
        xx, xy = v[: k * k].reshape(k, k), v[k * k : k * k + k]
        yy, w, wy = v[k * k + k :]
        beta = np.linalg.lstsq(xx + 1e-9 * np.eye(k), xy, rcond=None)[0]
        rest = yy - 2 * beta @ xy + beta @ xx @ beta
        spread = yy - wy * wy / w
        out.append([*map(float, beta), float(1 - rest / spread) if spread > 0 else 0.0])
    return pd.Series(out)


def lime_tabular(
    df: DataFrame, key: str, features: Sequence[str], scorer: Scorer, num_samples: int = 5000, seed: int = 42
) -> DataFrame:
    """(key, feature, coefficient, intercept, fit): a weighted linear fit around each row.

    Samples are the row plus one deviation of noise per feature; weights fall with the distance in
    deviations, kernel width 0.75 * sqrt(features). Coefficients are per deviation.
    """
    m = len(features)
    deviation = df.agg(*[F.coalesce(F.stddev_pop(S.clean(f)), F.lit(0.0)).alias(f) for f in features]).first()
    rows = S.spread_out(df.select(key, *[S.clean(f).alias(f) for f in features])).withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.lit(num_samples)))
    )
    rows = with_once(rows, {f"_z{j}": F.when(F.col("_i") == 1, 0.0).otherwise(_normal(seed + j, key, "_i")) for j in range(m)})
    scored = scorer.add(rows, {f: F.col(f) + F.col(f"_z{j}") * F.lit(deviation[f]) for j, f in enumerate(features)}, "_f")
    distance = sum((F.col(f"_z{j}") * F.col(f"_z{j}") for j in range(m)), F.lit(0.0))
    scored = scored.withColumn("_w", F.sqrt(F.exp(-distance / F.lit(0.75 * 0.75 * m))))
    design = [F.lit(1.0), *[F.col(f"_z{j}") for j in range(m)]]
    w, f = F.col("_w"), F.col("_f")
    sums = [F.sum(w * a * b) for a in design for b in design] + [F.sum(w * a * f) for a in design]
    sums += [F.sum(w * f * f), F.sum(w), F.sum(w * f)]
    solved = scored.groupBy(key).agg(F.array(*sums).alias("_s")).withColumn("_b", _solve("_s", F.lit(m + 1)))
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), F.get("_b", j + 1).alias("coefficient")) for j, x in enumerate(features)])
    return solved.select(key, F.get("_b", 0).alias("intercept"), F.get("_b", m + 1).alias("fit"), F.inline(cells))


def global_importance(attributions: DataFrame) -> DataFrame:
    """(feature, importance, max, min, rank) from mean absolute attributions."""
    stats = attributions.groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("importance"),
        F.max("attribution").alias("max_attribution"),
        F.min("attribution").alias("min_attribution"),
    )
    # One row per feature: the ranking window is as small as the list of features.
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def importance_details(importances: DataFrame, top_k: int | None = None) -> DataFrame:
    """Rank, ratio to the mean and an interval of a tenth of the spread, beside the summary figures."""
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("importance").desc(), "feature")
    return (
        importances.withColumns(
            {
                "rank": F.row_number().over(order),
                "mean_importance": F.avg("importance").over(everything),
                "std_importance": F.stddev_pop("importance").over(everything),
                "max_importance": F.max("importance").over(everything),
                "min_importance": F.min("importance").over(everything),
            }
        )
        .where(F.lit(True) if top_k is None else F.col("rank") <= top_k)
        .withColumns(
            {
                "relative_importance": F.try_divide(F.col("importance"), F.col("mean_importance")),
                "low": F.col("importance") - 0.1 * F.col("std_importance"),
                "high": F.col("importance") + 0.1 * F.col("std_importance"),
            }
        )
    )


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mutual_information): plug-in estimate over equal-width bins, in nats."""
    ranges = df.agg(*[F.struct(F.min(S.clean(f)).alias("lo"), F.max(S.clean(f)).alias("hi")).alias(f) for f in features]).first()
    from tallywatch.functions.bands import equal_width_bin

    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), equal_width_bin(S.clean(f), F.lit(ranges[f]["lo"]), F.lit(ranges[f]["hi"]), bins).alias("bin"))
            for f in features
        ]
    )
    joint = (
        df.select(F.col(label).alias("_y"), F.inline(cells))
        .where("bin IS NOT NULL AND _y IS NOT NULL")
        .groupBy("feature", "bin", "_y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = joint.groupBy("feature").agg(F.sum("n").alias("_t"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("_b"))
    by_y = joint.groupBy("feature", "_y").agg(F.sum("n").alias("_l"))
    rows = joint.join(total, "feature").join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "_y"])
    term = F.col("n") / F.col("_t") * F.log(F.col("n").cast("double") * F.col("_t") / (F.col("_b").cast("double") * F.col("_l")))
    return rows.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_information"))


# ---------------------------------------------------------------- response curves


def _grid(feature: str, low: float, high: float, n: int) -> Column:
    """Array of (feature, point, grid_value)."""
    return F.transform(
        linspace(F.lit(low), F.lit(high), n),
        lambda v, i: F.struct(F.lit(feature).alias("feature"), i.alias("point"), v.alias("grid_value")),
    )


def partial_dependence(df: DataFrame, features: Sequence[str], scorer: Scorer, n: int = 100) -> DataFrame:
    """(feature, point, grid_value, mean_prediction) over n points from the smallest to the largest value."""
    ends = df.agg(*[F.struct(F.min(S.clean(f)).alias("lo"), F.max(S.clean(f)).alias("hi")).alias(f) for f in features]).first()
    grids = F.concat(*[_grid(f, ends[f]["lo"], ends[f]["hi"], n) for f in features])
    rows = S.spread_out(df.select(*[S.clean(f).alias(f) for f in features])).select("*", F.inline(grids))
    inputs = {f: F.when(F.col("feature") == f, F.col("grid_value")).otherwise(F.col(f)) for f in features}
    return scorer.add(rows, inputs, "_f").groupBy("feature", "point", "grid_value").agg(F.avg("_f").alias("mean_prediction"))


def accumulated_local_effects(df: DataFrame, features: Sequence[str], scorer: Scorer, bins: int = 20) -> DataFrame:
    """(feature, bin, low, high, n, effect): local differences within quantile bins, summed and centred."""
    shares = [i / bins for i in range(bins + 1)]
    cuts = S.exact_quantiles(S.long_numeric(df, features, keep=()), shares).collect()
    edges = {f: sorted({r["quantile"] for r in cuts if r["feature"] == f}) for f in features}
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), S.clean(f).alias("value"), F.array(*[F.lit(e) for e in edges[f]]).alias("edges"))
            for f in features
        ]
    )
    rows = df.select(*[S.clean(f).alias(f) for f in features], F.inline(cells)).where(F.col("value").isNotNull())
    below = interval_bin(F.col("value"), F.col("edges"), bins + 1)
    rows = rows.withColumn("bin", F.least(F.greatest(below, F.lit(1)), F.greatest(F.size("edges") - 1, F.lit(1))))
    rows = rows.withColumns({"low": F.get("edges", F.col("bin") - 1), "high": F.coalesce(F.get("edges", F.col("bin")), F.get("edges", F.col("bin") - 1))})
    for end in ("low", "high"):
        rows = scorer.add(rows, {f: F.when(F.col("feature") == f, F.col(end)).otherwise(F.col(f)) for f in features}, f"_{end}")
    local = rows.groupBy("feature", "bin", "low", "high").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_high") - F.col("_low")).alias("step")
    )
    # At most ``bins`` rows per feature from here on.
    running = local.withColumn("_sum", F.sum("step").over(Window.partitionBy("feature").orderBy("bin")))
    middle = F.sum((F.col("_sum") - F.col("step") / 2) * F.col("n")).over(Window.partitionBy("feature")) / F.sum("n").over(
        Window.partitionBy("feature")
    )
    return running.select("feature", "bin", "low", "high", "n", (F.col("_sum") - middle).alias("effect"))


def ice_curves(
    df: DataFrame, key: str, features: Sequence[str], scorer: Scorer, sample: int | None = None, points: int = 50, seed: int = 42
) -> DataFrame:
    """(feature, key, point, grid_value, prediction, average): curves over the 5th to 95th percentile.

    Curves of all rows, or of ``sample`` rows picked by hash; the average is that of the rows shown.
    """
    cuts = S.quantiles_wide(S.long_numeric(df, features, keep=()), {"lo": 0.05, "hi": 0.95}).collect()
    ends = {r["feature"]: (r["lo"], r["hi"]) for r in cuts}
    picked = df.select(key, *[S.clean(f).alias(f) for f in features])
    if sample is not None:
        picked = S.top_rows(picked.withColumns({"_all": F.lit(1), "_h": _hash(seed, key)}), ["_all"], [F.col("_h")], sample)
    grids = F.concat(*[_grid(f, *ends[f], points) for f in features])
    rows = S.spread_out(picked.select(key, *features)).select("*", F.inline(grids))
    inputs = {f: F.when(F.col("feature") == f, F.col("grid_value")).otherwise(F.col(f)) for f in features}
    curves = scorer.add(rows, inputs, "prediction")
    # Averages are combined before they move: one row per feature and point.
    averages = curves.groupBy("feature", "point").agg(F.avg("prediction").alias("average"))
    return curves.join(F.broadcast(averages), ["feature", "point"]).select("feature", key, "point", "grid_value", "prediction", "average")


# ---------------------------------------------------------------- what if


def what_if(base: DataFrame, scenarios: DataFrame, key: str, features: Sequence[str], scorer: Scorer) -> DataFrame:
    """(key, scenario, original, modified, change, confidence_change): scenarios hold only the changed features."""
    changed = scenarios.select(key, "scenario", *[F.col(f).alias(f"_{f}") for f in features])
    rows = base.select(key, *[S.clean(f).alias(f) for f in features]).join(changed, key)
    rows = scorer.add(rows, own_inputs(features), "original")
    rows = scorer.add(rows, {f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in features}, "modified")
    sure = lambda c: F.abs(F.col(c) - 0.5) * 2
    return rows.select(
        key, "scenario", "original", "modified",
        (F.col("modified") - F.col("original")).alias("change"),
        (sure("modified") - sure("original")).alias("confidence_change"),
    )


def scenario_compare(results: DataFrame) -> DataFrame:
    """Difference of each scenario from the original, and its share of the largest one per scenario set."""
    return results.withColumns(
        {
            "difference": F.col("modified") - F.col("original"),
            "relative": F.coalesce(F.try_divide(F.col("modified") - F.col("original"), F.abs("original")), F.lit(0.0)) * 100,
            "direction": F.when(F.col("modified") > F.col("original"), "up").when(F.col("modified") < F.col("original"), "down").otherwise("same"),
        }
    )


def counterfactuals(
    df: DataFrame, key: str, features: Sequence[str], scorer: Scorer, desired: float | None = None, max_changes: int = 5,
    ranges: dict[str, tuple[float, float]] | None = None, candidates: int = 100, keep: int = 5, seed: int = 42,
) -> DataFrame:
    """The best candidate changes per row: fewest changes first, then the smallest move.

    ``candidates`` variants are drawn per row by hash: which features change, and their new values
    (0.5 to 1.5 times the old one unless ``ranges`` says otherwise).
    """
    ranges = ranges or {}
    rows = scorer.add(S.spread_out(df.select(key, *[S.clean(f).alias(f) for f in features])), own_inputs(features), "original")
    rows = rows.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(candidates))))
    k = min(max_changes, len(features))
    # The filter and the order below use every draw several times.
    rows = with_once(
        rows,
        {f"_{use[0]}_{f}": S.hash_unit(f"{seed}|{use[1]}|{f}", F.col(key), F.col("candidate")) for use in (("d", "pick"), ("v", "value")) for f in features},
    )
    inputs, changes = {}, []
    for f in features:
        ahead = sum((F.when(F.col(f"_d_{g}") < F.col(f"_d_{f}"), 1).otherwise(0) for g in features if g != f), F.lit(0))
        a, b = (F.lit(float(ranges[f][0])), F.lit(float(ranges[f][1]))) if f in ranges else (F.col(f) * 0.5, F.col(f) * 1.5)
        lo, hi = F.least(a, b), F.greatest(a, b)
        drawn = lo + F.col(f"_v_{f}") * (hi - lo)
        rows = rows.withColumn(f"new_{f}", F.when(ahead < k, drawn).otherwise(F.col(f)))
        inputs[f] = F.col(f"new_{f}")
        changes.append(F.when(F.abs(F.col(f"new_{f}") - F.col(f)) > 1e-6, 1).otherwise(0))
    scored = scorer.add(rows, inputs, "prediction").withColumns(
        {"num_changes": sum(changes, F.lit(0)), "prediction_change": F.col("prediction") - F.col("original")}
    )
    if desired is not None:
        scored = scored.where(F.abs(F.col("prediction") - desired) < F.abs(F.col("original") - desired))
    best = Window.partitionBy(key).orderBy("num_changes", F.abs("prediction_change"), "candidate")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= keep)
        .select(key, "rank", "candidate", "original", "prediction", "prediction_change", "num_changes", *[f"new_{f}" for f in features])
    )


def sensitivity(
    df: DataFrame, key: str, features: Sequence[str], scorer: Scorer, n: int | None = None, noise: float = 0.1, seed: int = 42
) -> DataFrame:
    """(feature, sensitivity): mean absolute change of the score under noise of ``noise`` deviations.

    All rows, or ``n`` rows picked by hash.
    """
    spread = df.agg(*[F.coalesce(F.stddev_pop(S.clean(f)), F.lit(0.0)).alias(f) for f in features]).first()
    rows = df.select(key, *[S.clean(f).alias(f) for f in features])
    if n is not None:
        rows = S.top_rows(rows.withColumns({"_all": F.lit(1), "_h": _hash(seed, key)}), ["_all"], [F.col("_h")], n).select(key, *features)
    rows = scorer.add(rows, own_inputs(features), "_base")
    for j, f in enumerate(features):
        rows = scorer.add(rows, own_inputs(features) | {f: F.col(f) + _normal(seed + j, key) * F.lit(spread[f] * noise)}, f"_s_{f}")
    wide = rows.agg(*[F.avg(F.abs(F.col(f"_s_{f}") - F.col("_base"))).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "sensitivity")


# ---------------------------------------------------------------- trees


def _nominal(name: str, values: int) -> Column:
    return F.col(name).alias(name, metadata={"ml_attr": {"name": name, "type": "nominal", "vals": [str(i) for i in range(values)]}})


def surrogate_tree(
    df: DataFrame, features: Sequence[str], scorer: Scorer, max_depth: int = 5, cutoff: float | None = 0.5, categories: dict[str, int] | None = None
):
    """Fit a tree to the scorer's decisions (or scores with ``cutoff`` None).

    ``categories`` names features that hold codes 0, 1, ... and how many; they are split by sets of codes.
    Returns (model, one-row fidelity table).
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from tallywatch.operators.performance import classification_metrics, regression_metrics

    rows = score(df.select(*[S.clean(f).alias(f) for f in features]), scorer, features)
    target = F.col("score") if cutoff is None else (F.col("score") >= cutoff).cast("double")
    rows = rows.select(*[_nominal(f, categories[f]) if f in (categories or {}) else f for f in features], "score")
    vectors = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows.withColumn("label", target))
    maker = DecisionTreeRegressor if cutoff is None else DecisionTreeClassifier
    model = maker(maxDepth=max_depth, minInstancesPerNode=10, seed=42).fit(vectors)
    predicted = model.transform(vectors).select("label", "prediction")
    if cutoff is None:
        fidelity = regression_metrics(predicted, "label", "prediction").select(F.col("r2_score").alias("fidelity"), "n")
    else:
        fidelity = classification_metrics(predicted, "label", "prediction").select(F.col("accuracy").alias("fidelity"), "n")
    return model, fidelity


def tree_nodes(model, features: Sequence[str]) -> list[dict]:
    """The nodes of a fitted tree, read from its saved node table: see ``trees.saved_nodes``."""
    return saved_nodes(model, features)[0][1]


NODE_SCHEMA = "node_id int, parent_id int, depth int, feature string, threshold double, side string, prediction double, categories array<double>"


def node_table(spark, nodes: Sequence[dict]) -> DataFrame:
    return local_table(spark, [tuple(n.get(c.split()[0]) for c in NODE_SCHEMA.split(", ")) for n in nodes], NODE_SCHEMA)


def _condition(node: dict, side: str) -> str:
    if node.get("categories") is not None:
        return f"{node['feature']} {'in' if side == 'left' else 'not in'} {{{', '.join(f'{c:g}' for c in node['categories'])}}}"
    return f"{node['feature']} {'<=' if side == 'left' else '>'} {node['threshold']:.3f}"


def _paths(nodes: Sequence[dict]) -> dict[int, list[str]]:
    by_id = {n["node_id"]: n for n in nodes}
    paths: dict[int, list[str]] = {}
    for n in nodes:
        path, at = [], n
        while at["parent_id"] is not None:
            parent = by_id[at["parent_id"]]
            path.append(_condition(parent, at["side"]))
            at = parent
        paths[n["node_id"]] = path[::-1]
    return paths


def leaf_of(nodes: Sequence[dict]) -> Column:
    """The leaf a row falls into, as one expression."""
    children: dict[int | None, list[dict]] = {}
    for n in nodes:
        children.setdefault(n["parent_id"], []).append(n)

    def walk(n: dict) -> Column:
        if n["feature"] is None:
            return F.lit(n["node_id"])
        kids = {c["side"]: c for c in children[n["node_id"]]}
        return F.when(goes_left(n), walk(kids["left"])).otherwise(walk(kids["right"]))

    return walk(children[None][0])


def node_stats(df: DataFrame, nodes: Sequence[dict], label: str) -> DataFrame:
    """(node_id, samples, impurity, purity) of every node, from class counts per leaf over the whole table."""
    paths = {}
    for n in nodes:
        chain, at = [n["node_id"]], n
        while at["parent_id"] is not None:
            at = next(m for m in nodes if m["node_id"] == at["parent_id"])
            chain.append(at["node_id"])
        paths[n["node_id"]] = chain
    leaves = [n["node_id"] for n in nodes if n["feature"] is None]
    lineage = F.create_map(*[x for leaf in leaves for x in (F.lit(leaf), F.array(*[F.lit(i) for i in paths[leaf]]))])
    cells = df.groupBy(leaf_of(nodes).alias("leaf"), F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    spread = cells.withColumn("node_id", F.explode(F.try_element_at(lineage, F.col("leaf"))))
    classes = spread.groupBy("node_id", "_y").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n")
    return classes.groupBy("node_id").agg(
        total.alias("samples"),
        (1.0 - F.sum(F.col("_n").cast("double") * F.col("_n")) / (total.cast("double") * total)).alias("impurity"),
        (F.max("_n") / total).alias("purity"),
        F.max_by("_y", F.struct("_n", "_y")).alias("majority"),
    )


def tree_stats(nodes: Sequence[dict], stats: DataFrame) -> DataFrame:
    """Nodes, leaves, largest and mean leaf depth, mean leaf purity."""
    table = node_table(stats.sparkSession, nodes)
    leaf = F.col("feature").isNull()
    return table.join(stats, "node_id", "left").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(leaf).alias("leaves"),
        F.max("depth").alias("max_depth"),
        F.avg(F.when(leaf, F.col("depth"))).alias("mean_leaf_depth"),
        F.avg(F.when(leaf, F.col("purity"))).alias("mean_leaf_purity"),
    )


def decision_rules(df: DataFrame, nodes: Sequence[dict], label: str, min_confidence: float = 0.8, min_support: int = 10) -> DataFrame:
    """(leaf, rule, prediction, support, confidence): root-to-leaf conditions, largest support first."""
    paths = _paths(nodes)
    rows = [
        (n["node_id"], " AND ".join(paths[n["node_id"]]))
        for n in nodes
        if n["feature"] is None
    ]
    texts = local_table(df.sparkSession, rows, "node_id int, rule string")
    impurity = F.col("impurity")
    return (
        node_stats(df, nodes, label)
        .join(F.broadcast(texts), "node_id")
        .withColumn("confidence", F.when(impurity < 0.5, 1 - impurity).otherwise(impurity))
        .where((F.col("samples") >= min_support) & (F.col("confidence") >= min_confidence))
        .select(F.col("node_id").alias("leaf"), "rule", F.col("majority").alias("prediction"), F.col("samples").alias("support"), "confidence")
        .orderBy(F.col("support").desc(), "leaf")
    )


IMPORTANCE_METHODS = {
    "permutation": permutation_importance,
    "drop_column": drop_column_importance,
    "mutual_information": mutual_information,
    "interactions": interaction_matrix,
    "partial_dependence": partial_dependence,
    "ale": accumulated_local_effects,
}


def register_importance(name: str, function) -> None:
    """Add an importance method under a name."""
    IMPORTANCE_METHODS[name] = function
