"""Preprocessing steps.

A step that needs statistics fetches them first (a few numbers per column) and then is a
plain projection, like the fit and transform of a feature transformer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.operators import aggregates as A
from tallywatch.operators import summaries as S
from tallywatch.operators.neighbours import nearest_rows

MAX_CATEGORIES = 1000


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str) -> dict[str, object]:
    """What missing cells become: mean, median, or the most frequent value (smallest on ties)."""
    if strategy == "mean":
        row = df.agg(*[F.avg(S.clean(c)).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns if row[c] is not None}
    if strategy == "median":
        rows = S.exact_quantiles(S.long_numeric(df, columns, keep=()), [0.5]).collect()
        return {r["feature"]: r["quantile"] for r in rows}
    if strategy == "most_frequent":
        numeric = set(S.numeric_columns(df))
        out: dict[str, object] = {}
        for group, maker in (
            ([c for c in columns if c in numeric], S.long_numeric),
            ([c for c in columns if c not in numeric], S.long_categorical),
        ):
            if group:
                counts = maker(df, group, keep=()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
                modes = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
                out.update({r["feature"]: r["mode"] for r in modes.collect()})
        return out
    raise ValueError(f"unknown strategy: {strategy}")


def fill_missing(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> DataFrame:
    values = fill_values(df, columns, strategy)
    doubles = {c for c, t in df.dtypes if t in ("float", "double")}
    return df.select(
        *[
            F.coalesce(S.clean(c) if c in doubles else F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c)
            for c in df.columns
        ]
    )


def categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct values; more than ``limit`` is an error, as each becomes a column."""
    rows = df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = False) -> DataFrame:
    """0/1 columns ``<column>_<category>``; a null is 0 in all of them."""
    made = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}")
        for c in columns
        for v in categories(df, c)[1 if drop_first else 0 :]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *made)


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by the 0-based position of its value among the sorted distinct values."""
    out = df
    for c in columns:
        distinct = df.select(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")).where("value IS NOT NULL").distinct()
        codes = S.ordered_codes(distinct).select(F.col("value").alias(f"_{c}"), F.col("code").cast("int").alias(f"_{c}_code"))
        codes = S.broadcast_if_small(codes)
        out = out.join(codes, out[c].cast("string") == codes[f"_{c}"], "left").drop(f"_{c}")
    return out.select(*[F.col(f"_{c}_code").alias(c) if c in columns else F.col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of 0 acts as 1."""
    row = df.agg(
        *[F.avg(S.clean(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(S.clean(c)).alias(f"s_{c}") for c in columns]
    ).first()

    def scaled(c: str) -> Column:
        mean, std = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0
        return ((S.clean(c) - F.lit(mean)) / F.lit(std if std != 0.0 else 1.0)).alias(c)

    return df.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


STEPS = {
    "drop_columns": drop_columns,
    "fill_missing": fill_missing,
    "one_hot": one_hot,
    "label_encode": label_encode,
    "standard_scale": standard_scale,
}


def apply_steps(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Apply {type, params} steps in order."""
    out = df
    for step in steps:
        if step["type"] not in STEPS:
            raise ValueError(f"unknown step: {step['type']}")
        out = out.transform(STEPS[step["type"]], **step.get("params", {}))
    return out


def train_validation_test_split(
    df: DataFrame, key: Sequence[str], train: float = 0.8, validation: float = 0.1, test: float = 0.1, seed: int = 42
) -> DataFrame:
    """Tag rows with ``split`` at exact sizes, in hash order of a unique key."""
    if abs(train + validation + test - 1.0) > 1e-6:
        raise ValueError("the ratios must add up to 1")
    cuts = {r["share"]: r["cut"] for r in S.hash_cuts(df, str(seed), key, [train, train + validation]).collect()}
    h = S.hash_text(str(seed), key)
    low, high = cuts.get(float(train), ""), cuts.get(float(train + validation), "")
    return df.withColumn(
        "split", F.when(h <= F.lit(low), "train").when(h <= F.lit(high), "validation").otherwise("test")
    )


def stratified_split(df: DataFrame, key: Sequence[str], stratum: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Tag rows with ``split`` so that every stratum, null being one, gives the same share to the test set."""
    cuts = S.hash_cuts(df, str(seed), key, [1.0 - test_size], [stratum]).select(stratum, "cut")
    joined = S.null_safe_join(df, S.broadcast_if_small(cuts), [stratum], "left")
    return joined.withColumn(
        "split", F.when(S.hash_text(str(seed), key) <= F.col("cut"), "train").otherwise("test")
    ).select(*df.columns, "split")


def cap_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Values outside the fences moved onto them."""
    fences = {r["feature"]: r for r in A.iqr_fences(S.long_numeric(df, columns, keep=()), factor).collect()}

    def capped(c: str) -> Column:
        v = S.clean(c)
        return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(fences[c]["low"])), F.lit(fences[c]["high"]))).alias(c)

    return df.select(*[capped(c) if c in fences else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(x - median) / iqr within each group; an iqr of 0 acts as 1."""
    long_df = S.long_numeric(df, columns, keep=(group,)).where(F.col(group).isNotNull())
    q = S.quantiles_wide(long_df, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["feature", group])
    wide = q.groupBy(group).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("q2"))).alias(f"_m_{c}") for c in columns],
        *[F.max(F.when(F.col("feature") == c, F.col("q3") - F.col("q1"))).alias(f"_i_{c}") for c in columns],
    )

    def scaled(c: str) -> Column:
        width = F.col(f"_i_{c}")
        return ((S.clean(c) - F.col(f"_m_{c}")) / F.when(width != 0, width).otherwise(1.0)).alias(c)

    return df.join(S.broadcast_if_small(wide), group, "left").select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def engineer(
    df: DataFrame,
    interactions: Sequence[tuple[str, str]] = (),
    polynomials: dict[str, int] | None = None,
    ratios: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Products, powers and guarded ratios as new columns."""
    made = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in interactions}
    for c, degree in (polynomials or {}).items():
        made |= {f"{c}_pow{d}": F.pow(F.col(c).cast("double"), F.lit(float(d))) for d in range(2, degree + 1)}
    made |= {
        f"{a}_per_{b}": F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for a, b in ratios
    }
    return df.withColumns(made)


def time_features(df: DataFrame, ts: str) -> DataFrame:
    from tallywatch.functions.text import time_features as parts

    return df.withColumns(parts(F.col(ts)))


def smote(
    df: DataFrame, key: str, features: Sequence[str], label: str, k_neighbors: int = 5, sampling_strategy: str | dict[str, int] = "auto", seed: int = 42
) -> DataFrame:
    """New rows of the smaller classes (Chawla et al. 2002): source, neighbour, copy, the features, and the label.

    With "auto" every class grows to the size of the largest; a dictionary gives the wanted size per class. The new rows of a class are dealt evenly over its rows, the
    first in hash order getting one more; each lies between its source and one of the ``k_neighbors`` nearest rows of the class, chosen, as is the place
    between them, by hash. Rows with missing features count for their class but are no source; a row without neighbours gives none.
    """
    sizes = {str(r["g"]): r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    goal = dict.fromkeys(sizes, max(sizes.values(), default=0)) if sampling_strategy == "auto" else sampling_strategy
    missing = {g: goal[g] - n for g, n in sizes.items() if goal.get(g, 0) > n}
    if not missing:
        missing = {"": 0}
    small = df.where(F.col(label).cast("string").isin(*missing))
    near = nearest_rows(small, label, key, features, k_neighbors).where(F.size("near") > 0)
    ranked = S.hash_rank(near, f"{seed}", [key], [label])
    wanted = F.create_map(*[F.lit(v) for item in missing.items() for v in item])[F.col(label)]
    total = F.col("rank_total")
    copies = F.floor(wanted / total) + (F.col("rank") <= wanted % total).cast("long")
    made = ranked.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    pick = F.floor(S.hash_unit(f"{seed}n", F.col(key), F.col("copy")) * F.size("near")).cast("int")
    gap = S.hash_unit(f"{seed}g", F.col(key), F.col("copy"))
    made = made.withColumn("_to", F.get("near", pick)).withColumn("_gap", gap)
    place = [(F.get("x", i) + F.col("_gap") * (F.get(F.col("_to.x"), i) - F.get("x", i))).alias(f) for i, f in enumerate(features)]
    return made.select(F.col(key).alias("source"), F.col("_to.key").alias("neighbour"), "copy", *place, label)
