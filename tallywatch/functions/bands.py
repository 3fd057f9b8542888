"""Ladders, conditions and score normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, cutoffs: Sequence[float], labels: Sequence[str], inclusive: bool = True) -> Column:
    """First label whose cutoff is reached, cutoffs in falling order; the last label is the rest.

    ``inclusive`` chooses between ``>=`` and ``>``.
    """
    if len(labels) != len(cutoffs) + 1:
        raise ValueError("one label more than cutoffs is needed")
    out = None
    for cut, label in zip(cutoffs, labels):
        hit = value >= cut if inclusive else value > cut
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(labels[-1]) if out is not None else F.lit(labels[-1])


def meets(value: Column, operator: Column, threshold: Column) -> Column:
    """Six comparison operators; equality within 1e-9; an unknown operator never holds."""
    gap = F.abs(value - threshold)
    return F.coalesce(
        F.when(operator == ">", value > threshold)
        .when(operator == "<", value < threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", gap < 1e-9)
        .when(operator == "!=", gap >= 1e-9),
        F.lit(False),
    )


# What a method's statistic is divided by before it is capped at 1.
SCORE_DIVISORS = {"population_stability_index": 0.5, "kl_divergence": 2.0}


def normalised_score(method: Column, statistic: Column, p_value: Column | None = None) -> Column:
    """1-p for tests, the capped and scaled distance for the rest."""
    divisor = F.lit(1.0)
    for name, value in SCORE_DIVISORS.items():
        divisor = F.when(method == name, value).otherwise(divisor)
    distance = F.least(F.lit(1.0), statistic / divisor)
    if p_value is None:
        return distance
    return F.when(p_value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - p_value))).otherwise(distance)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percentage(value: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(value, total) * 100.0)


def percentage_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.when(new == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(
        F.try_divide(new - old, old) * 100.0
    )


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of [low, high] cut in ``bins``; the last bin is closed. An empty range is widened by 0.5."""
    flat = high == low
    lo = F.when(flat, low - 0.5).otherwise(low)
    hi = F.when(flat, high + 0.5).otherwise(high)
    raw = F.floor(F.try_divide(value - lo, (hi - lo) / F.lit(float(bins))))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def interval_bin(value: Column, edges: Column, most: int) -> Column:
    """Number of edges strictly below the value: right-closed intervals with open ends.

    ``most`` is the largest number of edges; comparing one by one keeps this in generated code.
    """
    return sum((F.when(value > F.get(edges, i), 1).otherwise(0) for i in range(most)), F.lit(0))


def linspace(low: Column, high: Column, n: int) -> Column:
    """Array of n evenly spaced points."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / float(n - 1))
