"""Tail probabilities that Spark SQL has no function for.

They are applied to summary rows only (one per feature and method), so the pandas
UDFs below see a handful of rows however large the input table is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KS_TERMS = 100


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value as a Column expression."""
    z = statistic * F.sqrt(n.cast("double") * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z),
    )
    return F.when(z < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


def chi2_tail(statistic: float, dof: float) -> float:
    return gamma_upper(dof / 2.0, statistic / 2.0)


def student_two_sided(t: float, dof: float) -> float:
    """Two-sided Student t tail through the regularised incomplete beta function."""
    x = dof / (dof + t * t)
    return _beta_regularised(dof / 2.0, 0.5, x)


def _beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


# Significance levels and coefficients of the k-sample Anderson-Darling
# critical values published by Scholz & Stephens (1987), table 1.
AD_SIGNIFICANCE = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
AD_B0 = (0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085)
AD_B1 = (-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615)
AD_B2 = (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154)



def harmonic(n: int) -> tuple[float, float]:
    """Sums of 1/i and of 1/i^2 for i up to ``n``, any size alike.

    Both are taken at n + 16 by their asymptotic expansions, off by less than 1e-11 from there on, less the sixteen
    terms too many.
    """
    m = n + 16.0
    first = math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6)
    second = math.pi**2 / 6 - 1 / m + 1 / (2 * m**2) - 1 / (6 * m**3) + 1 / (30 * m**5) - 1 / (42 * m**7)
    return first - sum(1.0 / (n + i) for i in range(1, 17)), second - sum(1.0 / (n + i) ** 2 for i in range(1, 17))


def anderson_darling_normalised(a2: float, n: float, m: float) -> float:
    """Standardise the two-sample midrank statistic with its exact variance.

    With N = n + m the variance needs h, the sum of 1/i for i < N, and g, the sum of 1 / ((N - i) j) for i < j < N; the latter
    equals the sum of 1/i^2 for i < N, less 2 h / N.
    """
    total = int(n + m)
    big_h = 1.0 / n + 1.0 / m
    h, squares = harmonic(total - 1)
    g = squares - 2.0 * h / total
    k = 2
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * big_h
    b = (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * big_h - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * big_h + 4 * h
    d = (2 * h + 6) * k * k - 4 * h * k
    big = float(total)
    variance = (a * big**3 + b * big**2 + c * big + d) / ((big - 1) * (big - 2) * (big - 3))
    return (a2 - (k - 1)) / math.sqrt(variance)


def anderson_darling_p(statistic: float) -> float:
    critical = np.array(AD_B0) + np.array(AD_B1) + np.array(AD_B2)
    fit = np.polyfit(critical, np.log(AD_SIGNIFICANCE), 2)
    return float(np.clip(math.exp(np.polyval(fit, min(max(statistic, -50.0), 50.0))), 0.001, 0.25)) if (
        critical.min() <= statistic <= critical.max()
    ) else (0.25 if statistic < critical.min() else 0.001)


def _elementwise(func, *series: pd.Series) -> pd.Series:
    out = []
    for values in zip(*series):
        bad = any(v is None or (isinstance(v, float) and math.isnan(v)) for v in values)
        out.append(None if bad else func(*[float(v) for v in values]))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _elementwise(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def chi2_p(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return _elementwise(lambda s, d: 1.0 if d < 1 else chi2_tail(s, d), statistic, dof)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _elementwise(lambda a, b: student_two_sided(abs(a), b), t, dof)


@F.pandas_udf(DoubleType())
def ad_statistic(a2: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return _elementwise(anderson_darling_normalised, a2, n, m)


@F.pandas_udf(DoubleType())
def ad_p(statistic: pd.Series) -> pd.Series:
    return _elementwise(anderson_darling_p, statistic)
