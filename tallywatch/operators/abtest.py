"""Comparing two model versions on live traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.functions import pvalues
from tallywatch.functions.bands import share
from tallywatch.operators import summaries as S


def assign_arm(test_id: str, key: Column, traffic_split: float = 0.5) -> Column:
    """'B' for the share ``traffic_split`` of keys, else 'A'; a key keeps its arm."""
    return F.when(S.hash_unit(test_id, key) < traffic_split, "B").otherwise("A")


def arm_metrics(rows: DataFrame, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Traffic and outcome per arm from rows (keys, arm, user_id, success 0/1, value)."""
    by_user = rows.groupBy(*keys, "arm", "user_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("success").alias("successes"),
        F.sum("value").alias("value"),
        F.sum(F.col("value") * F.col("value")).alias("squares"),
    )
    n = F.sum("requests")
    variance = F.try_divide(F.sum("squares") - F.sum("value") * F.sum("value") / n, (n - 1).cast("double"))
    return by_user.groupBy(*keys, "arm").agg(
        F.count(F.lit(1)).alias("users"),
        n.alias("requests"),
        F.sum("successes").alias("successes"),
        share(F.sum("successes"), n).alias("success_rate"),
        share(F.sum("value"), n).alias("mean_value"),
        variance.alias("variance"),
    )


def significance(arms: DataFrame, alpha: float = 0.05, min_sample: int = 100, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    """Two-proportion z and Welch t between arms, with p-values and the winner by success rate."""

    def of(arm: str, name: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(name))).cast("double").alias(f"{name}_{arm.lower()}")

    wide = arms.groupBy(*keys).agg(
        *[of(a, n) for a in ("A", "B") for n in ("requests", "successes", "success_rate", "mean_value", "variance")]
    )
    na, nb = F.col("requests_a"), F.col("requests_b")
    pooled = (F.col("successes_a") + F.col("successes_b")) / (na + nb)
    z = F.try_divide(F.col("success_rate_b") - F.col("success_rate_a"), F.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb)))
    va, vb = F.col("variance_a") / na, F.col("variance_b") / nb
    t = F.try_divide(F.col("mean_value_b") - F.col("mean_value_a"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) * (va + vb), va * va / (na - 1) + vb * vb / (nb - 1))
    scored = wide.withColumns({"z": z, "t": t, "dof": dof}).withColumns(
        {"z_p_value": pvalues.normal_p(F.abs("z")), "t_p_value": pvalues.student_p(F.col("t"), F.col("dof"))}
    )
    enough = (na >= min_sample) & (nb >= min_sample)
    sure = enough & (F.col("z_p_value") < alpha)
    return scored.withColumns(
        {
            "enough_samples": enough,
            "significant": sure,
            "winner": F.when(sure, F.when(F.col("z") > 0, "B").otherwise("A")).otherwise("none"),
        }
    )


def progress(tests: DataFrame) -> DataFrame:
    """Rows (test_id, status, current, target) with percent done, at most 100."""
    return tests.withColumn("progress", F.least(share(F.col("current"), F.col("target")) * 100, F.lit(100.0)))


def status_counts(tests: DataFrame) -> DataFrame:
    return tests.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
