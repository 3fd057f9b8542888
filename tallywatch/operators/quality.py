"""Data quality, profiling and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions.bands import share
from tallywatch.operators import aggregates as A
from tallywatch.operators import ranking, setops
from tallywatch.operators import summaries as S
from tallywatch.session import local_table, materialise


def _missing(df: DataFrame, name: str) -> Column:
    numeric = dict(df.dtypes)[name] in ("float", "double")
    c = F.col(name)
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, rows, missing) from one aggregate; NaN counts as missing."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    return wide.unpivot(["_rows"], df.columns, "column", "missing").select("column", F.col("_rows").alias("rows"), "missing")


QUARTILES = (0.25, 0.75)


def _outside(df: DataFrame, looks: Sequence, factor: float) -> DataFrame:
    """``outlier_counts`` from the second scan on."""
    counts = S.condensed(df, looks, QUARTILES, factor)
    fences = A.iqr_fences(counts, factor, "n")
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return (
        counts.join(F.broadcast(fences), "feature")
        .groupBy("feature", "q1", "q3", "low", "high")
        .agg(F.sum("n").alias("values"), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outliers"))
    )


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """(feature, q1, q3, low, high, values, outliers) for every numeric column at once, from two scans."""
    looks, _ = S.first_look(df, list(columns or S.numeric_columns(df)), QUARTILES)
    return _outside(df, looks, factor)


def quality_score(rows: Column, cells: Column, missing: Column, duplicates: Column, outliers: Column) -> Column:
    """Weighted 0.4 / 0.3 / 0.3 of completeness, uniqueness and regularity, clamped to [0, 1]."""
    raw = 0.4 * (1 - share(missing, cells)) + 0.3 * (1 - share(duplicates, rows)) + 0.3 * (1 - share(outliers, rows))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def assess_quality(df: DataFrame, alert_below: float = 0.7) -> DataFrame:
    """One row: totals, score, issue list and whether an alert is due."""
    missing = [F.count_if(_missing(df, c)).alias(f"_missing_{i}") for i, c in enumerate(df.columns)]
    looks, seen = S.first_look(df, S.numeric_columns(df), QUARTILES, *missing)
    absent = [seen[f"_missing_{i}"] for i in range(len(df.columns))]
    outliers = _outside(df, looks, 1.5).agg(F.coalesce(F.sum("outliers"), F.lit(0)).cast("bigint").alias("outliers"))
    merged = setops.duplicate_count(df, seen["_rows"]).withColumn("_k", F.lit(1)).join(outliers.withColumn("_k", F.lit(1)), "_k").select(
        "rows", "duplicate_rows", F.lit(sum(absent)).cast("bigint").alias("missing_values"),
        F.lit(sum(a > 0 for a in absent)).cast("bigint").alias("columns_with_missing"), "outliers",
    )
    issues = F.concat_ws(
        ";",
        F.when(F.col("columns_with_missing") > 0, F.concat(F.lit("missing values in "), F.col("columns_with_missing"), F.lit(" columns"))),
        F.when(F.col("duplicate_rows") > 0, F.concat(F.col("duplicate_rows"), F.lit(" duplicate rows"))),
        F.when(F.col("outliers") > F.col("rows") * 0.1, F.lit("high number of outliers")),
    )
    cells = F.col("rows") * len(df.columns)
    return merged.withColumn(
        "quality_score",
        quality_score(F.col("rows"), cells, F.col("missing_values"), F.col("duplicate_rows"), F.col("outliers")),
    ).withColumns({"issues": issues, "alert": F.col("quality_score") < alert_below})


def compute_statistics(df: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """The parts of a statistics report, each a table of its own."""
    categorical = S.categorical_columns(df)
    return {
        "missing": missing_counts(df),
        "duplicates": setops.duplicate_count(df),
        "numeric": A.describe(df),
        "distinct": A.distinct_counts(df, categorical),
        "top_values": ranking.top_values(df, categorical, k),
    }


def profile(df: DataFrame, k: int = 10) -> DataFrame:
    """One row per column: kind, missing, distinct, moments and median, or the k most frequent values."""
    numeric, categorical = S.numeric_columns(df), S.categorical_columns(df)
    names = [*numeric, *categorical]
    missing = [F.count_if(_missing(df, c)).alias(f"_missing_{i}") for i, c in enumerate(names)]
    looks, seen = S.first_look(df, numeric, (0.5,), *missing)
    known = {r["feature"]: r for r in looks}
    columns = local_table(
        df.sparkSession,
        [(c, seen["_rows"], seen[f"_missing_{i}"], *[known[c][m] if c in known else None for m in ("mean", "std", "min", "max")]) for i, c in enumerate(names)],
        "feature string, rows bigint, missing bigint, mean double, std double, min double, max double",
    )
    # The counts of all values serve distinct values, medians and the most frequent values.
    counts = materialise(S.long_categorical(df, names, keep=()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    distinct = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_values"))
    number = F.col("value").cast("double")
    numbers = counts.where(F.col("feature").isin(*numeric)).select("feature", number.alias("value"), "n").where(~F.isnan("value"))
    medians = S.quantiles_wide(numbers, {"median": 0.5}, weight="n").drop("n")
    tops = (
        S.top_rows(counts.where(F.col("feature").isin(*categorical)), ["feature"], [F.col("n").desc(), F.col("value")], k)
        .groupBy("feature")
        .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                                          lambda r: F.concat(r["value"], F.lit("="), r["n"]))).alias("top_values"))
    )
    return (
        columns.select("feature", "rows", "missing")
        .withColumn("kind", F.when(F.col("feature").isin(*numeric), "numeric").otherwise("categorical"))
        .withColumn("missing_rate", share(F.col("missing"), F.col("rows")))
        .join(distinct, "feature", "left")
        .join(columns.drop("rows", "missing"), "feature", "left")
        .join(medians, "feature", "left")
        .join(tops, "feature", "left")
    )


def validate_rules(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Violations of required_columns, no_missing_values and data_type rules: (rule, column, detail)."""
    spark, types = df.sparkSession, dict(df.dtypes)
    fixed, watched = [], []
    for rule in rules:
        kind, params = rule["type"], rule.get("params", {})
        if kind == "required_columns":
            absent = [c for c in params.get("columns", []) if c not in types]
            if absent:
                fixed.append((kind, ",".join(absent), "missing columns"))
        elif kind == "no_missing_values":
            watched += [c for c in params.get("columns", df.columns) if c in types]
        elif kind == "data_type":
            column, wanted = params["column"], params["expected_type"]
            if column in types and types[column] != wanted:
                fixed.append((kind, column, f"{types[column]}, expected {wanted}"))
        else:
            raise ValueError(f"unknown rule type: {kind}")
    out = local_table(spark, fixed, "rule string, column string, detail string")
    if watched:
        gaps = missing_counts(df.select(*watched)).where("missing > 0")
        out = out.unionByName(
            gaps.select(F.lit("no_missing_values").alias("rule"), "column", F.concat(F.col("missing"), F.lit(" missing values")).alias("detail"))
        )
    return out


def validation_summary(violations: DataFrame, total_rules: int) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(total_rules).alias("total_rules"),
        "violations",
        (F.col("violations") == 0).alias("is_valid"),
        (F.lit(1.0) if total_rules == 0 else (F.lit(total_rules) - F.col("violations")) / F.lit(float(total_rules))).alias("success_rate"),
    )


def validate_dataframe(
    df: DataFrame,
    min_rows: int = 1,
    max_rows: int | None = None,
    required: Sequence[str] = (),
    numeric: Sequence[str] = (),
) -> DataFrame:
    """(level, check, detail): errors for shape and types, warnings for nulls, copies and infinities."""
    types, numbers = dict(df.dtypes), S.numeric_columns(df)
    out = local_table(df.sparkSession,
        [("error", "required_columns", c) for c in required if c not in types]
        + [("error", "numeric_columns", c) for c in numeric if c in types and c not in numbers],
        "level string, check string, detail string",
    )
    sizes = setops.duplicate_count(df).select("rows", "duplicate_rows")
    shape = F.array(
        F.when(F.col("rows") < min_rows, F.struct(F.lit("error").alias("level"), F.lit("min_rows").alias("check"), F.col("rows").cast("string").alias("detail"))),
        F.when(F.lit(False) if max_rows is None else F.col("rows") > max_rows, F.struct(F.lit("error").alias("level"), F.lit("max_rows").alias("check"), F.col("rows").cast("string").alias("detail"))),
        F.when(F.col("duplicate_rows") > 0, F.struct(F.lit("warning").alias("level"), F.lit("duplicate_rows").alias("check"), F.col("duplicate_rows").cast("string").alias("detail"))),
    )
    out = out.unionByName(sizes.select(F.inline(F.array_compact(shape))))
    gaps = missing_counts(df).where("missing > 0")
    out = out.unionByName(
        gaps.select(F.lit("warning").alias("level"), F.lit("missing_values").alias("check"), F.concat("column", F.lit("="), "missing").alias("detail"))
    )
    doubles = [c for c in numbers if types[c] in ("float", "double")]
    if doubles:
        wide = df.agg(*[F.count_if(F.abs(c) == float("inf")).alias(c) for c in doubles])
        infinite = wide.unpivot([], doubles, "column", "n").where("n > 0")
        out = out.unionByName(
            infinite.select(F.lit("warning").alias("level"), F.lit("infinite_values").alias("check"), F.col("column").alias("detail"))
        )
    return out


def quality_rules(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Completeness, range, format and uniqueness rules, all row-wise ones in a single aggregate.

    A rule is {name, type, column, threshold (percent), min, max, pattern}. Result:
    (name, type, column, violations, pass_rate, threshold, passed).
    """
    checks, unique = {}, []
    for r in rules:
        c = F.col(r["column"])
        if r["type"] == "completeness":
            checks[r["name"]] = c.isNull()
        elif r["type"] == "range":
            checks[r["name"]] = ~F.coalesce(c.between(r["min"], r["max"]), F.lit(True))
        elif r["type"] == "format":
            checks[r["name"]] = ~F.coalesce(c.rlike(r["pattern"]), F.lit(True))
        elif r["type"] == "uniqueness":
            unique.append(r)
        else:
            raise ValueError(f"unknown rule type: {r['type']}")
    out = None
    if checks:
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(e).alias(n) for n, e in checks.items()])
        out = wide.unpivot(["_rows"], list(checks), "name", "violations")
    for r in unique:
        copies = df.where(F.col(r["column"]).isNotNull()).groupBy(r["column"]).agg(F.count(F.lit(1)).alias("_n"))
        rows = copies.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations")
        ).withColumn("name", F.lit(r["name"]))
        out = rows.select("_rows", "name", "violations") if out is None else out.unionByName(rows)
    table = local_table(df.sparkSession,
        [(r["name"], r["type"], r["column"], float(r["threshold"])) for r in rules],
        "name string, type string, column string, threshold double",
    )
    rate = F.when(F.col("_rows") == 0, 100.0).otherwise((1 - share(F.col("violations"), F.col("_rows"))) * 100)
    return (
        out.join(F.broadcast(table), "name")
        .withColumn("pass_rate", rate)
        .select("name", "type", "column", "violations", "pass_rate", "threshold", (F.col("pass_rate") >= F.col("threshold")).alias("passed"))
    )


def quality_dimensions(df: DataFrame, validity: Column, ts: str, fresh_after: Column) -> DataFrame:
    """completeness, uniqueness, validity, timeliness in percent and their mean."""
    one = F.lit(1)
    facts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        sum((F.count_if(_missing(df, c)) for c in df.columns), F.lit(0)).alias("_missing"),
        F.count_if(validity).alias("_valid"),
        F.count_if(F.col(ts) >= fresh_after).alias("_fresh"),
    ).withColumn("_k", one)
    copies = setops.duplicate_count(df).select(F.col("duplicate_rows").alias("_copies")).withColumn("_k", one)
    rows = F.col("_rows")
    parts = facts.join(copies, "_k").select(
        ((1 - share(F.col("_missing"), rows * len(df.columns))) * 100).alias("completeness"),
        ((1 - share(F.col("_copies"), rows)) * 100).alias("uniqueness"),
        (share(F.col("_valid"), rows) * 100).alias("validity"),
        (share(F.col("_fresh"), rows) * 100).alias("timeliness"),
    )
    mean = (F.col("completeness") + F.col("uniqueness") + F.col("validity") + F.col("timeliness")) / 4
    return parts.withColumn("overall", mean)


def quality_degradation(cur: DataFrame, ref: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """(column, missing_rate, missing_delta, outlier_rate, affected_by) for columns that got worse."""
    now = missing_counts(cur.select(*columns)).select(
        "column", "rows", share(F.col("missing"), F.col("rows")).alias("missing_rate")
    )
    if ref is None:
        base = now.withColumns({"missing_delta": F.col("missing_rate"), "_limit": F.lit(0.2)})
    else:
        then = missing_counts(ref.select(*columns)).select(
            "column", share(F.col("missing"), F.col("rows")).alias("_then")
        )
        base = now.join(then, "column").withColumns(
            {"missing_delta": F.col("missing_rate") - F.col("_then"), "_limit": F.lit(0.05)}
        )
    numeric = [c for c in columns if c in S.numeric_columns(cur)]
    outliers = outlier_counts(cur, numeric).select(F.col("feature").alias("column"), "outliers")
    rows = base.join(outliers, "column", "left").withColumn(
        "outlier_rate", share(F.coalesce(F.col("outliers"), F.lit(0)), F.col("rows"))
    )
    kinds = F.concat_ws(
        ";",
        F.when(F.col("missing_delta") > F.col("_limit"), "missing_values"),
        F.when(F.col("outlier_rate") > 0.1, "outliers"),
    )
    return (
        rows.withColumn("affected_by", kinds)
        .where("affected_by <> ''")
        .select("column", "missing_rate", "missing_delta", "outlier_rate", "affected_by")
    )
