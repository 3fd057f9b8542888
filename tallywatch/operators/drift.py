"""Distribution drift between a reference and a current side.

Input is a ``sided`` table: feature columns plus ``side`` ('ref' / 'cur'), see
``summaries.pair_sides``. Output is long: one row per feature (and method).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallywatch.functions import pvalues
from tallywatch.functions.bands import equal_width_bin, interval_bin, normalised_score, share
from tallywatch.operators import summaries as S
from tallywatch.session import local_table, materialise

# Default decision thresholds per method.
THRESHOLDS = {
    "kolmogorov_smirnov": 0.05,
    "anderson_darling": 0.05,
    "mann_whitney_u": 0.05,
    "chi_square": 0.05,
    "wasserstein": 0.1,
    "jensen_shannon_divergence": 0.1,
    "kl_divergence": 0.1,
    "hellinger_distance": 0.1,
    "population_stability_index": 0.1,
    "characteristic_stability_index": 0.1,
    "earth_movers_distance": 0.1,
    "energy_distance": 0.1,
    "maximum_mean_discrepancy": 0.1,
    "drift_ensemble": 0.1,
    "adaptive_windowing": 0.1,
}
TESTS = ("kolmogorov_smirnov", "anderson_darling", "mann_whitney_u", "chi_square")
NUMERIC_ONLY = ("anderson_darling", "mann_whitney_u", "wasserstein")
CATEGORICAL_ONLY = ("chi_square",)
EPSILON = 1e-10
PSI_FLOOR = 0.001
HISTOGRAM_BINS = 50


# ---------------------------------------------------------------- distributions
#
# Every function below reads counts: (feature, value, c_ref, c_cur), either value counts or
# single rows (``summaries.as_counts``). Binned counts carry the side totals n_*, the number
# of cells k and of empty cells z_*, so that one aggregate per feature gives every distance.


def value_range(counts: DataFrame, only: str | None = None) -> DataFrame:
    rows = counts if only is None else counts.where(F.col(only) > 0)
    return rows.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def _sum_sides(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("feature", *keys).agg(F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur"))


def _completed(cells: DataFrame, bins: Column) -> DataFrame:
    """Every bin of every feature, absent ones with zero counts, from at most ``bins`` cells per feature."""
    packed = cells.groupBy("feature").agg(
        F.map_from_entries(
            F.collect_list(F.struct("bucket", F.struct(F.col("c_ref"), F.col("c_cur"))))
        ).alias("_cells"),
        F.sum("c_ref").alias("n_ref"),
        F.sum("c_cur").alias("n_cur"),
        F.count_if(F.col("c_ref") > 0).alias("_f_ref"),
        F.count_if(F.col("c_cur") > 0).alias("_f_cur"),
        F.max(bins).cast("bigint").alias("k"),
    )
    return (
        packed.where("n_ref > 0 AND n_cur > 0")
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
        .withColumn("_cell", F.try_element_at("_cells", F.col("bucket")))
        .select(
            "feature",
            "bucket",
            F.coalesce(F.col("_cell.c_ref"), F.lit(0)).alias("c_ref"),
            F.coalesce(F.col("_cell.c_cur"), F.lit(0)).alias("c_cur"),
            "n_ref",
            "n_cur",
            "k",
            (F.col("k") - F.col("_f_ref")).alias("z_ref"),
            (F.col("k") - F.col("_f_cur")).alias("z_cur"),
        )
    )


def histogram(counts: DataFrame, bins: int = HISTOGRAM_BINS, ranges: DataFrame | None = None) -> DataFrame:
    """H: counts per equal-width bin of the joint range (or of ``ranges``; outside values are left out)."""
    limited = ranges is not None
    ranges = ranges if limited else value_range(counts)
    rows = counts.join(F.broadcast(ranges), "feature")
    if limited:
        rows = rows.where(F.col("value").between(F.col("low"), F.col("high")))
    binned = rows.withColumn("bucket", equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins))
    return _completed(_sum_sides(binned, "bucket"), F.lit(bins))


def category_counts(counts: DataFrame) -> DataFrame:
    """H for categories: the union of both sides' values with aligned counts; input must be value counts."""
    totals = counts.groupBy("feature").agg(
        F.sum("c_ref").alias("n_ref"),
        F.sum("c_cur").alias("n_cur"),
        F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("c_ref") == 0).alias("z_ref"),
        F.count_if(F.col("c_cur") == 0).alias("z_cur"),
    )
    return counts.withColumnRenamed("value", "bucket").join(totals.where("n_ref > 0 AND n_cur > 0"), "feature")


def decile_counts(counts: DataFrame, parts: int = 10, limits: DataFrame | None = None) -> DataFrame:
    """Counts per reference-quantile bin (right-closed, open ends, equal edges merged)."""
    limits = limits if limits is not None else S.slot_limits(counts)
    cuts = S.exact_quantiles(counts, [i / parts for i in range(1, parts)], limits=limits, weight="c_ref")
    edges = cuts.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
    binned = counts.join(F.broadcast(edges), "feature").select(
        "feature",
        interval_bin(F.col("value"), F.col("edges"), parts - 1).alias("bucket"),
        (F.size("edges") + 1).alias("n_bins"),
        "c_ref",
        "c_cur",
    )
    return _completed(_sum_sides(binned, "bucket", "n_bins"), F.col("n_bins"))


def align_distributions(counts: DataFrame, fill: float = 0.0) -> DataFrame:
    """Category shares of both sides side by side, missing ones filled."""
    rows = category_counts(counts)
    p, q = _filled(fill)
    return rows.select("feature", F.col("bucket").alias("category"), p.alias("share_ref"), q.alias("share_cur"))


def _plain_shares() -> tuple[Column, Column]:
    return F.col("c_ref") / F.col("n_ref"), F.col("c_cur") / F.col("n_cur")


def _filled(floor: float) -> tuple[Column, Column]:
    p, q = _plain_shares()
    return F.when(F.col("c_ref") == 0, F.lit(floor)).otherwise(p), F.when(F.col("c_cur") == 0, F.lit(floor)).otherwise(q)


def _floored(floor: float) -> tuple[Column, Column]:
    """Shares with empty cells at ``floor``, summing to one again."""
    p, q = _filled(floor)
    return p / (1.0 + floor * F.col("z_ref")), q / (1.0 + floor * F.col("z_cur"))


def _lifted(epsilon: float) -> tuple[Column, Column]:
    """Shares with ``epsilon`` added to every cell, summing to one again."""
    p, q = _plain_shares()
    return (p + epsilon) / (1.0 + epsilon * F.col("k")), (q + epsilon) / (1.0 + epsilon * F.col("k"))


def distances(h: DataFrame, categorical: bool = False, epsilon: float = EPSILON) -> DataFrame:
    """Jensen-Shannon distance, KL (current from reference) and Hellinger per feature, in one aggregate.

    The Jensen-Shannon value is the square root of the divergence, natural logarithm. With
    ``epsilon`` 0 empty cells add nothing.
    """
    if epsilon == 0.0:
        p, q = _plain_shares()
    else:
        p, q = _floored(epsilon) if categorical else _lifted(epsilon)
    mid = (p + q) / 2.0

    def part(x: Column, against: Column) -> Column:
        return F.coalesce(F.when((x > 0) & (against > 0), x * F.log(x / against)), F.lit(0.0))

    raw_p, raw_q = _plain_shares()
    gap = F.sqrt(raw_p) - F.sqrt(raw_q)
    return h.groupBy("feature").agg(
        F.sqrt(F.greatest((F.sum(part(p, mid)) + F.sum(part(q, mid))) / 2.0, F.lit(0.0))).alias("jensen_shannon"),
        F.sum(part(q, p)).alias("kl"),
        F.sqrt(0.5 * F.sum(gap * gap)).alias("hellinger"),
    )


def psi(h: DataFrame, floor: float = PSI_FLOOR) -> DataFrame:
    """Population stability index of binned or categorical counts; a missing share counts as ``floor``."""
    p, q = _floored(floor)
    return h.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def psi_equal_width(counts: DataFrame, bins: int = 10) -> DataFrame:
    """PSI over equal-width bins of the reference range; current values outside it are left out."""
    p, q = _filled(EPSILON)
    h = histogram(counts, bins, value_range(counts, "c_ref"))
    return h.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi_equal_width"))


def relative_shift(counts: DataFrame, categorical: bool = False) -> DataFrame:
    """Relative change of the mean, or of the number of distinct values for categories."""
    if categorical:
        a, b = F.count_if(F.col("c_ref") > 0).cast("double"), F.count_if(F.col("c_cur") > 0).cast("double")
    else:
        a = F.sum(F.col("value") * F.col("c_ref")) / F.sum("c_ref")
        b = F.sum(F.col("value") * F.col("c_cur")) / F.sum("c_cur")
    return counts.groupBy("feature").agg(
        F.coalesce(F.try_divide(F.abs(b - a), F.abs(a)), F.lit(0.0)).alias("shift")
    )


def csi(psi_rows: DataFrame, shifts: DataFrame) -> DataFrame:
    """PSI plus a tenth of the relative shift."""
    return psi_rows.join(shifts, "feature").withColumn("csi", F.col("psi") + 0.1 * F.col("shift"))


def chi_square(h: DataFrame) -> DataFrame:
    """2 x K contingency test on category counts, Yates' correction when K = 2."""
    row, total = F.col("c_ref") + F.col("c_cur"), F.col("n_ref") + F.col("n_cur")

    def part(own: str) -> Column:
        expected = row.cast("double") * F.col(f"n_{own}") / total
        gap = F.abs(F.col(f"c_{own}") - expected)
        gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / expected

    stats = h.groupBy("feature").agg(
        F.when(F.max("k") < 2, 0.0).otherwise(F.sum(part("ref") + part("cur"))).alias("chi_square"),
        (F.max("k") - 1).cast("int").alias("dof"),
    )
    return stats.withColumn("chi_square_p", pvalues.chi2_p(F.col("chi_square"), F.col("dof").cast("double")))


# ---------------------------------------------------------------- rank statistics


def _gap() -> Column:
    upto_ref = (F.col("before_c_ref") + F.col("c_ref")) / F.col("total_c_ref")
    upto_cur = (F.col("before_c_cur") + F.col("c_cur")) / F.col("total_c_cur")
    return upto_ref - upto_cur


def _ad_term(own: str, total: Column) -> Column:
    ties = (F.col("c_ref") + F.col("c_cur")).cast("double")
    mid = F.col("before_c_ref") + F.col("before_c_cur") + ties / 2.0
    upto = F.col(f"before_c_{own}") + F.col(f"c_{own}") / 2.0
    spread = mid * (total - mid) - total * ties / 4.0
    off = total * upto - mid * F.col(f"total_c_{own}")
    return F.coalesce(F.try_divide(ties / total * off * off, spread), F.lit(0.0)) / F.col(f"total_c_{own}")


def rank_statistics(e: DataFrame) -> DataFrame:
    """KS, Wasserstein, energy, Mann-Whitney and Anderson-Darling sums from one pass over E."""
    gap = _gap()
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    ties = (F.col("c_ref") + F.col("c_cur")).cast("double")
    total = (F.col("total_c_ref") + F.col("total_c_cur")).cast("double")
    mid_rank = F.col("before_c_ref") + F.col("before_c_cur") + (ties + 1.0) / 2.0
    return e.where("total_c_ref > 0 AND total_c_cur > 0").groupBy("feature").agg(
        F.max("total_c_ref").alias("n_ref"),
        F.max("total_c_cur").alias("n_cur"),
        F.max(F.abs(gap)).alias("ks"),
        F.sum(F.abs(gap) * width).alias("wasserstein"),
        F.sqrt(2.0 * F.sum(gap * gap * width)).alias("energy"),
        F.sum(mid_rank * F.col("c_ref")).alias("rank_sum_ref"),
        F.sum(ties * ties * ties - ties).alias("tie_sum"),
        ((F.max(total) - 1.0) / F.max(total) * (F.sum(_ad_term("ref", total)) + F.sum(_ad_term("cur", total)))).alias("ad"),
    )


def kolmogorov_smirnov(stats: DataFrame) -> DataFrame:
    return stats.withColumn("ks_p", pvalues.kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")))


def mann_whitney(stats: DataFrame) -> DataFrame:
    """U of the reference side, tie-corrected normal approximation."""
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    total = n + m
    u = F.col("rank_sum_ref") - n * (n + 1.0) / 2.0
    spread = F.sqrt(n * m / 12.0 * ((total + 1.0) - F.try_divide(F.col("tie_sum"), total * (total - 1.0))))
    z = F.coalesce(F.try_divide(F.greatest(u, n * m - u) - n * m / 2.0 - 0.5, spread), F.lit(0.0))
    return stats.withColumns({"mwu": u, "mwu_z": z}).withColumn("mwu_p", pvalues.normal_p(F.col("mwu_z")))


def anderson_darling(stats: DataFrame) -> DataFrame:
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    return stats.withColumn("ad_statistic", pvalues.ad_statistic(F.col("ad"), n, m)).withColumn(
        "ad_p", pvalues.ad_p(F.col("ad_statistic"))
    )


def coded_categories(counts: DataFrame) -> DataFrame:
    """Category value counts with numbers in sorted order, so rank statistics apply to them."""
    return S.ordered_codes(counts).select("feature", F.col("code").cast("double").alias("value"), "c_ref", "c_cur")


def ecdf(counts: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """E: value counts with cumulative counts per side, for every feature at once."""
    return S.cumulative(counts, ("c_ref", "c_cur"), limits if limits is not None else S.slot_limits(counts))


# ---------------------------------------------------------------- kernel, ensemble, windows


#: Terms of the expansion below; with cells of half a kernel width the rest is under 1e-8 of a kernel value.
MMD_TERMS = 18
#: Kernel widths beyond which exp(-gamma d^2) is below 1e-16.
MMD_REACH = 6.1


@F.pandas_udf(DoubleType())
def _cell_kernel(distance, one, two, gamma):  # pragma: no cover - runs in the worker
    """Sum of exp(-gamma (x - y)^2) over all x of a cell and y of another, from their moments.

    With x - y = distance + u the kernel is a series in u whose coefficients are Hermite polynomials of the
    distance; powers of u = a - b split into moments of either cell.
    """
    import math

    import numpy as np
    import pandas as pd

    a, b = np.array(one.tolist(), dtype=float), np.array(two.tolist(), dtype=float)
    g = math.sqrt(float(gamma.iloc[0])) if len(gamma) else 1.0
    z = g * distance.to_numpy(dtype=float)
    base = np.exp(-z * z)
    total = np.zeros(len(z))
    before, now = np.zeros(len(z)), np.ones(len(z))
    for k in range(a.shape[1] if len(z) else 0):
        u = sum(math.comb(k, i) * (-1) ** (k - i) * a[:, i] * b[:, k - i] for i in range(k + 1))
        total += (-1) ** k * now * base * u / math.factorial(k)
        before, now = now, 2 * z * now - 2 * k * before
    return pd.Series(total, dtype="float64")


def mmd(long_df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Kernel discrepancy of all rows of both sides: see ``mmd_of_counts``."""
    return mmd_of_counts(S.as_counts(long_df), gamma)


def mmd_of_counts(counts: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Kernel discrepancy from value counts: mean k(r, r') + mean k(c, c') - 2 mean k(r, c), k = exp(-gamma d^2).

    Values fall into cells of half a kernel width. One aggregate leaves a few moments per feature, side
    and cell; a cell then meets only the cells within reach of the kernel, at most 26 of them. Work grows with the rows
    and the cells, never with pairs of rows.
    """
    width = 0.5 / gamma**0.5
    cell = F.floor(F.col("value") / width)
    u = (F.col("value") - (F.col("_cell") + 0.5) * width) * gamma**0.5
    rows = counts.select("feature", "value", "c_ref", "c_cur", cell.alias("_cell")).withColumn("_u", u)

    def moments_of(side: str) -> Column:
        n = F.col(f"c_{side}")
        total = lambda k: F.sum(F.when(n > 0, n * F.pow("_u", F.lit(float(k)))))
        return F.struct(F.lit(side).alias("side"), F.array(F.sum(n).cast("double"), *[total(k) for k in range(1, MMD_TERMS)]).alias("_m"))

    both = rows.groupBy("feature", "_cell").agg(F.array(moments_of("ref"), moments_of("cur")).alias("_both"))
    moments = materialise(both.select("feature", "_cell", F.inline("_both")).where(F.get("_m", 0) > 0))
    sizes = moments.groupBy("feature").agg(*[F.sum(F.when(F.col("side") == s, F.get("_m", 0))).alias(f"_{s}") for s in ("ref", "cur")])
    reach = int(MMD_REACH / 0.5) + 1
    near = moments.withColumn("_near", F.explode(F.sequence(F.col("_cell") - reach, F.col("_cell") + reach)))
    other = moments.select("feature", F.col("side").alias("_side"), F.col("_cell").alias("_near"), F.col("_m").alias("_o"))
    distance = (F.col("_cell") - F.col("_near")) * width * gamma**0.5
    # Within a side a pair of cells counts for both its orders; between the sides ref meets cur only.
    ahead = (F.col("side") == F.col("_side")) & (F.col("_cell") <= F.col("_near"))
    across = (F.col("side") == "ref") & (F.col("_side") == "cur")
    times = F.when(across | (F.col("_cell") == F.col("_near")), 1.0).otherwise(2.0)
    met = near.join(other, ["feature", "_near"]).where(ahead | across).select(
        "feature", "side", "_side", (times * _cell_kernel(distance, F.col("_m"), F.col("_o"), F.lit(1.0))).alias("_k")
    )
    sums = met.groupBy("feature").agg(
        *[F.sum(F.when((F.col("side") == s) & (F.col("_side") == t), F.col("_k"))).alias(f"_{s}_{t}") for s, t in (("ref", "ref"), ("cur", "cur"), ("ref", "cur"))]
    )
    value = (
        F.col("_ref_ref") / (F.col("_ref") * F.col("_ref"))
        + F.col("_cur_cur") / (F.col("_cur") * F.col("_cur"))
        - 2 * F.coalesce("_ref_cur", F.lit(0.0)) / (F.col("_ref") * F.col("_cur"))
    )
    return sizes.where("_ref > 0 AND _cur > 0").join(sums, "feature").select("feature", value.alias("mmd"))


def mmd_categorical(counts: DataFrame, gamma: float = 1.0) -> DataFrame:
    """The same for categories from value counts: kernel 1 when equal, exp(-2 gamma) otherwise, so shares suffice."""
    p, q = _plain_shares()
    factor = 1.0 - F.exp(F.lit(-2.0 * gamma))
    return category_counts(counts).groupBy("feature").agg((factor * F.sum((p - q) * (p - q))).alias("mmd"))


ENSEMBLE_NUMERIC = (
    "jensen_shannon_divergence",
    "population_stability_index",
    "kolmogorov_smirnov",
    "wasserstein",
    "mann_whitney_u",
)
ENSEMBLE_CATEGORICAL = (
    "jensen_shannon_divergence",
    "population_stability_index",
    "kolmogorov_smirnov",
    "chi_square",
)


def ensemble(report: DataFrame, members: Sequence[str]) -> DataFrame:
    """Mean and population spread of the members' scores, from report rows."""
    return (
        report.where(F.col("method").isin(*members))
        .groupBy("feature")
        .agg(
            F.avg("score").alias("statistic"),
            F.stddev_pop("score").alias("spread"),
            F.count(F.lit(1)).alias("members"),
        )
    )


WINDOW_SIZES = (50, 100, 200, 500)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sizes: Sequence[int] = WINDOW_SIZES) -> DataFrame:
    """The most recent n rows per key for each n in ``sizes``, tagged with ``window``."""
    recent = S.top_rows(df, keys, order, max(sizes))
    wanted = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("rank"))
    return recent.withColumn("window", F.explode(wanted))


def _window_histogram(counts: DataFrame, windows: DataFrame, sizes: Sequence[int], bins: int) -> DataFrame:
    """H per feature and window, named feature#window; a window's bins span the reference and that window.

    The reference is read once: a value's bins in all windows stand beside one another, and equal tuples of bins, of which there
    are few as bins follow the order of values, are counted together before they are spread over the windows.
    """
    spans = windows.groupBy("feature").pivot("window", list(sizes)).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    known = counts.where("c_ref > 0").groupBy("feature").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    ranges = known.join(spans, "feature")
    low = {w: F.least("_low", f"`{w}_low`") for w in sizes}
    high = {w: F.greatest("_high", f"`{w}_high`") for w in sizes}
    ranges = ranges.select("feature", *[F.struct(low[w].alias("low"), high[w].alias("high"), F.col(f"`{w}_low`").isNotNull().alias("full")).alias(f"w{w}") for w in sizes])
    table = S.broadcast_if_small(ranges)

    def bucket(w) -> Column:
        return equal_width_bin(F.col("value"), F.col(f"w{w}.low"), F.col(f"w{w}.high"), bins)

    tuples = counts.where("c_ref > 0").join(table, "feature").groupBy("feature", *[F.when(F.col(f"w{w}.full"), bucket(w)).alias(f"b{w}") for w in sizes]).agg(F.sum("c_ref").alias("c_ref"))
    places = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"b{w}").alias("bucket")) for w in sizes])
    ref = tuples.select("feature", "c_ref", F.inline(places)).where("bucket IS NOT NULL").withColumn("c_cur", F.lit(0).cast("long"))
    own = F.coalesce(*[F.when(F.col("window") == w, bucket(w)) for w in sizes])
    cur = windows.join(table, "feature").select("feature", F.lit(0).cast("long").alias("c_ref"), "window", own.alias("bucket"), F.lit(1).cast("long").alias("c_cur"))
    cells = ref.unionByName(cur).select(F.concat_ws("#", "feature", F.col("window").cast("string")).alias("feature"), "bucket", "c_ref", "c_cur")
    return _completed(_sum_sides(cells, "bucket"), F.lit(bins))


def adaptive_windowing(
    long_df: DataFrame, recent_first: Sequence[Column], sizes: Sequence[int] = WINDOW_SIZES, categorical: bool = False, counts: DataFrame | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Jensen-Shannon of the last 50 / 100 / 200 / 500 current rows against the reference.

    Weights fall as 1, 1/2, 1/3, 1/4 over the windows the current side can fill; a feature that fills none scores 0. ``counts`` are the value counts of
    both sides, if they are there already. Categories are compared by their counts, numbers in bins; a
    window's rows are at most the largest of ``sizes``, whatever the table holds.
    """
    cur = long_df.where(F.col("side") == "cur")
    counts = S.value_counts_by_side(long_df) if counts is None else counts
    sizes_cur = counts.groupBy("feature").agg(F.sum("c_cur").alias("_n")).where("_n > 0")
    windows = last_rows(cur, ["feature"], recent_first, sizes).join(S.broadcast_if_small(sizes_cur), "feature").where(F.col("window") <= F.col("_n"))
    windows = materialise(windows.select("feature", "window", "value"))
    if categorical:
        label = F.concat_ws("#", "feature", F.col("window").cast("string")).alias("feature")
        held = S.broadcast_if_small(windows.select("feature", "window").distinct())
        ref = counts.where("c_ref > 0").join(held, "feature").select(label, "value", "c_ref", F.lit(0).cast("long").alias("c_cur"))
        own = windows.select(label, "value", F.lit(0).cast("long").alias("c_ref"), F.lit(1).cast("long").alias("c_cur"))
        h = category_counts(_sum_sides(ref.unionByName(own), "value"))
    else:
        h = _window_histogram(counts, windows, sizes, bins)
    js = distances(h, categorical).select("feature", F.col("jensen_shannon").alias("statistic"))
    # The window stands behind the last mark: a feature's name may hold one too.
    window = F.substring_index("feature", "#", -1)
    rank = F.array_position(F.array(*[F.lit(s) for s in sizes]), window.cast("int"))
    name = F.col("feature").substr(F.lit(1), F.length("feature") - F.length(window) - 1)
    rows = js.select(name.alias("feature"), "statistic", (1.0 / rank).alias("w"))
    scored = rows.groupBy("feature").agg((F.sum(F.col("statistic") * F.col("w")) / F.sum("w")).alias("statistic"))
    return sizes_cur.select("feature").join(scored, "feature", "left").na.fill(0.0, ["statistic"])


# ---------------------------------------------------------------- registry and report


class Inputs:
    """Lazily built shared summaries of one report.

    ``counts`` are the value counts of the columns; everything but the windows is derived from them.
    """

    def __init__(self, sided: DataFrame, columns: Sequence[str], categorical: bool, counts: DataFrame, recency: Sequence[str] = ()):
        self.recency = list(recency)
        self.categorical = categorical
        self.counts = counts
        self.sided = sided
        self.columns = list(columns)
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def long(self, *keep: str) -> DataFrame:
        maker = S.long_categorical if self.categorical else S.long_numeric
        return maker(self.sided, self.columns, ["side", *keep])

    @property
    def limits(self) -> DataFrame:
        return self._once("limits", lambda: S.slot_limits(self.counts))

    @property
    def shape(self) -> DataFrame:
        """jensen_shannon, kl, hellinger per feature."""
        h = category_counts(self.counts) if self.categorical else histogram(self.counts)
        return distances(h, self.categorical)

    @property
    def table(self) -> DataFrame:
        return chi_square(category_counts(self.counts))

    @property
    def stability(self) -> DataFrame:
        """psi and csi per feature."""
        h = category_counts(self.counts) if self.categorical else decile_counts(self.counts, limits=self.limits)
        return csi(psi(h), relative_shift(self.counts, self.categorical))

    @property
    def ranks(self) -> DataFrame:
        if self.categorical:
            coded = coded_categories(self.counts)
            return kolmogorov_smirnov(rank_statistics(ecdf(coded)))
        stats = rank_statistics(ecdf(self.counts, self.limits))
        return anderson_darling(mann_whitney(kolmogorov_smirnov(stats)))

    @property
    def kernel(self) -> DataFrame:
        return mmd_categorical(self.counts) if self.categorical else mmd_of_counts(self.counts)

    @property
    def windows(self) -> DataFrame:
        """The most recent current rows against the reference."""
        newest = [F.col(c).desc() for c in self.recency]
        return adaptive_windowing(self.long(*self.recency), newest, categorical=self.categorical, counts=self.counts)


# method -> (summary, statistic column, p-value column)
METHODS: dict[str, tuple[str, str, str | None]] = {
    "kolmogorov_smirnov": ("ranks", "ks", "ks_p"),
    "anderson_darling": ("ranks", "ad_statistic", "ad_p"),
    "mann_whitney_u": ("ranks", "mwu", "mwu_p"),
    "chi_square": ("table", "chi_square", "chi_square_p"),
    "wasserstein": ("ranks", "wasserstein", None),
    "jensen_shannon_divergence": ("shape", "jensen_shannon", None),
    "kl_divergence": ("shape", "kl", None),
    "hellinger_distance": ("shape", "hellinger", None),
    "population_stability_index": ("stability", "psi", None),
    "characteristic_stability_index": ("stability", "csi", None),
    "earth_movers_distance": ("ranks", "wasserstein", None),
    "energy_distance": ("ranks", "energy", None),
    "maximum_mean_discrepancy": ("kernel", "mmd", None),
    "adaptive_windowing": ("windows", "statistic", None),
}
_CUSTOM: dict[str, Callable[[Inputs], DataFrame]] = {}


def register_method(name: str, builder: Callable[[Inputs], DataFrame], threshold: float = 0.1) -> None:
    """Add a drift method; ``builder`` gets the shared summaries and returns (feature, statistic)."""
    _CUSTOM[name] = builder
    METHODS[name] = (name, "statistic", None)
    THRESHOLDS[name] = threshold


def evaluate_thresholds(rows: DataFrame, custom: dict[str, float] | None = None) -> DataFrame:
    """Add ``threshold`` and ``drift_detected``: p below it for tests, statistic above it otherwise."""
    table = local_table(rows.sparkSession,
        list({**THRESHOLDS, **(custom or {})}.items()), "method string, threshold double"
    )
    flagged = F.when(F.col("p_value").isNotNull(), F.col("p_value") < F.col("threshold")).otherwise(
        F.col("statistic") > F.col("threshold")
    )
    return rows.join(F.broadcast(table), "method", "left").withColumn("drift_detected", F.coalesce(flagged, F.lit(False)))


def method_rows(inputs: Inputs, methods: Sequence[str]) -> DataFrame:
    """(feature, is_categorical, method, statistic, p_value, score) for all methods that apply."""
    skipped = NUMERIC_ONLY if inputs.categorical else CATEGORICAL_ONLY
    members = ENSEMBLE_CATEGORICAL if inputs.categorical else ENSEMBLE_NUMERIC
    wanted = [m for m in methods if m in METHODS and m not in skipped]
    needed = list(dict.fromkeys([*wanted, *(members if "drift_ensemble" in methods else ())]))
    sources: dict[str, list[str]] = {}
    for name in needed:
        sources.setdefault(METHODS[name][0], []).append(name)
    rows = None
    for source, names in sources.items():
        wide = _CUSTOM[source](inputs) if source in _CUSTOM else getattr(inputs, source)
        cells = F.array(
            *[
                F.struct(
                    F.lit(n).alias("method"),
                    F.col(METHODS[n][1]).cast("double").alias("statistic"),
                    (F.col(METHODS[n][2]) if METHODS[n][2] else F.lit(None).cast("double")).alias("p_value"),
                )
                for n in names
            ]
        )
        part = wide.select("feature", F.inline(cells))
        rows = part if rows is None else rows.unionByName(part)
    scored = rows.withColumn("score", normalised_score(F.col("method"), F.col("statistic"), F.col("p_value")))
    if "drift_ensemble" in methods:
        # A feature has one row per method, so its rows fit in one array; the mix is added there.
        row = F.struct("method", "statistic", "p_value", "score")
        packed = scored.groupBy("feature").agg(
            F.collect_list(row).alias("_rows"),
            F.avg(F.when(F.col("method").isin(*members), F.col("score"))).alias("_mix"),
        )
        mix = F.struct(
            F.lit("drift_ensemble").alias("method"),
            F.col("_mix").alias("statistic"),
            F.lit(None).cast("double").alias("p_value"),
            F.least(F.lit(1.0), F.col("_mix")).alias("score"),
        )
        kept = F.filter("_rows", lambda r: r["method"].isin(*wanted))
        scored = packed.select("feature", F.inline(F.concat(kept, F.array(mix))))
    return scored.select("feature", F.lit(inputs.categorical).alias("is_categorical"), "method", "statistic", "p_value", "score")


def column_counts(sided: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Value counts of numeric and of categorical columns from one pass over the source.

    They are written to the checkpoint folder, because every method reads them.
    """
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), S.clean(c).alias("number"), blank.alias("text")) for c in numeric],
        *[F.struct(F.lit(c).alias("feature"), none.alias("number"), F.col(c).cast("string").alias("text")) for c in categorical],
    )
    rows = sided.select("side", F.inline(cells)).where("number IS NOT NULL OR text IS NOT NULL")
    counts = materialise(
        rows.groupBy("feature", "number", "text").agg(
            F.count_if(F.col("side") == "ref").alias("c_ref"), F.count_if(F.col("side") == "cur").alias("c_cur")
        )
    )
    numbers = counts.where("number IS NOT NULL").select("feature", F.col("number").alias("value"), "c_ref", "c_cur")
    texts = counts.where("text IS NOT NULL").select("feature", F.col("text").alias("value"), "c_ref", "c_cur")
    return numbers, texts


def detect_drift(
    sided: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    methods: Sequence[str] | None = None,
    thresholds: dict[str, float] | None = None,
    recency: Sequence[str] = (),
) -> DataFrame:
    """Long report: every feature x every method that applies, with score and flag.

    A name that is no method is an error; no method that applies to the columns gives an empty report. ``recency`` names the columns that order
    rows by time, which adaptive windowing needs: it is left out of the default methods, and is an error if asked for, without them.
    """
    wanted = list(methods) if methods is not None else [*(m for m in METHODS if recency or m != "adaptive_windowing"), "drift_ensemble"]
    if "adaptive_windowing" in wanted and not recency:
        raise ValueError("adaptive_windowing needs the columns that order rows by time: recency")
    if unknown := [m for m in wanted if m not in METHODS and m != "drift_ensemble"]:
        raise ValueError(f"no such method: {', '.join(unknown)}")
    numbers, texts = column_counts(sided, numeric, categorical)
    parts = []
    for columns, is_text, counts in ((numeric, False, numbers), (categorical, True, texts)):
        skipped = NUMERIC_ONLY if is_text else CATEGORICAL_ONLY
        if columns and any(m not in skipped for m in wanted):
            parts.append(method_rows(Inputs(sided, columns, is_text, counts, recency), wanted))
    if not parts:
        return local_table(
            sided.sparkSession, [],
            "feature string, is_categorical boolean, method string, statistic double, p_value double, score double, threshold double, drift_detected boolean",
        )
    rows = parts[0]
    for extra in parts[1:]:
        rows = rows.unionByName(extra)
    return evaluate_thresholds(rows, thresholds).select(
        "feature", "is_categorical", "method", "statistic", "p_value", "score", "threshold", "drift_detected"
    )


def feature_scores(report: DataFrame) -> DataFrame:
    """Mean score per feature, whether any method flagged it, and which ones did."""
    return report.groupBy("feature", "is_categorical").agg(
        F.avg("score").alias("drift_score"),
        F.max("drift_detected").alias("drift_detected"),
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("method")))).alias("methods_triggered"),
    )


def overall_drift(report: DataFrame, cutoff: float = 0.1) -> DataFrame:
    per_feature = feature_scores(report)
    return per_feature.agg(
        F.coalesce(F.avg("drift_score"), F.lit(0.0)).alias("overall_drift_score"),
        F.count(F.lit(1)).alias("features_analyzed"),
        F.count_if("drift_detected").alias("features_with_drift"),
    ).withColumn("overall_drift_detected", F.col("overall_drift_score") > cutoff)


def method_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("method").agg(
        F.avg("score").alias("average_score"),
        F.max("score").alias("max_score"),
        F.count_if(F.col("score") > 0.1).alias("features_with_drift"),
        F.count_if("drift_detected").alias("features_flagged"),
        F.count(F.lit(1)).alias("total_features"),
    )


def feature_quality(sided: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing rate, distinct values and zero rate per feature and side."""
    numeric = set(S.numeric_columns(sided))
    cells = sided.select(
        "side", *[(S.clean(c).cast("string") if c in numeric else F.col(c).cast("string")).alias(c) for c in columns]
    ).unpivot(["side"], list(columns), "feature", "value")
    zero = F.col("feature").isin(*[c for c in columns if c in numeric]) & (F.expr("try_cast(value AS double)") == 0)
    # One row per distinct value first: exact distinct counts without collecting a set.
    by_value = cells.groupBy("side", "feature", "value").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(zero), F.lit(False)).alias("zero"))
    return by_value.groupBy("side", "feature").agg(
        F.sum("n").alias("rows"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("missing_rate"),
        F.count("value").alias("distinct_values"),
        (F.coalesce(F.sum(F.when(F.col("zero"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("zero_rate"),
    )


def portfolio_metrics(report: DataFrame, quality: DataFrame) -> DataFrame:
    """Volume, coverage, quality change and impact counts in one row."""
    sizes = quality.groupBy("feature").agg(
        F.max(F.when(F.col("side") == "ref", F.col("rows"))).alias("rows_ref"),
        F.max(F.when(F.col("side") == "cur", F.col("rows"))).alias("rows_cur"),
        (
            F.max(F.when(F.col("side") == "cur", F.col("missing_rate")))
            - F.max(F.when(F.col("side") == "ref", F.col("missing_rate")))
        ).alias("missing_change"),
    )
    flagged, score = F.col("drift_detected"), F.col("drift_score")
    return (
        feature_scores(report)
        .join(sizes, "feature", "left")
        .agg(
            F.max("rows_ref").alias("reference_size"),
            F.max("rows_cur").alias("current_size"),
            F.count(F.lit(1)).alias("total_features"),
            F.count_if(flagged).alias("features_with_drift"),
            F.avg("missing_change").alias("avg_missing_rate_change"),
            F.count_if(F.col("missing_change") > 0.05).alias("features_with_quality_degradation"),
            F.count_if(flagged & (score > 0.5)).alias("high_impact_features"),
            F.count_if(flagged & (score > 0.7)).alias("critical_drift_count"),
        )
        .withColumn("size_ratio", share(F.col("current_size"), F.col("reference_size")))
        .withColumn("volume_drift_detected", F.abs(F.col("size_ratio") - 1) > 0.2)
        .withColumn("drift_percentage", share(F.col("features_with_drift"), F.col("total_features")) * 100)
    )


def drift_recommendations(report: DataFrame, portfolio: DataFrame) -> DataFrame:
    """(priority, category, action, feature) rows that the report calls for; actions are codes."""
    overall = overall_drift(report).select("overall_drift_score")
    none = F.lit(None).cast("string")

    def rule(rows: DataFrame, when: Column, priority: str, category: str, action: Column, feature: Column = none):
        return rows.where(when).select(
            F.lit(priority).alias("priority"), F.lit(category).alias("category"), action.alias("action"), feature.alias("feature")
        )

    per_feature = feature_scores(report)
    score = F.col("overall_drift_score")
    parts = [
        rule(overall, score > 0.7, "critical", "model_intervention", F.lit("retrain")),
        rule(portfolio, F.col("volume_drift_detected"), "high", "data_collection", F.lit("check_volume")),
        rule(
            per_feature,
            F.col("drift_detected") & (F.col("drift_score") > 0.5),
            "high",
            "feature_monitoring",
            F.lit("watch"),
            F.col("feature"),
        ),
        rule(
            portfolio,
            F.col("features_with_quality_degradation") > 0,
            "medium",
            "data_quality",
            F.lit("repair"),
        ),
        rule(overall, score > 0.3, "medium", "monitoring", F.lit("monitor")),
    ]
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra)
    return out


def dataset_drift(report: DataFrame, drift_share: float = 0.5) -> DataFrame:
    """One test per column (KS or chi-square) and the share of drifted columns against ``drift_share``."""
    kept = report.where(
        (F.col("is_categorical") & (F.col("method") == "chi_square"))
        | (~F.col("is_categorical") & (F.col("method") == "kolmogorov_smirnov"))
    )
    return kept.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("drift_detected").alias("drifted_columns"),
        share(F.count_if("drift_detected"), F.count(F.lit(1))).alias("drifted_share"),
    ).withColumn("dataset_drift", F.col("drifted_share") >= drift_share)


def validate_compatibility(ref: DataFrame, cur: DataFrame, min_rows: int = 10) -> DataFrame:
    """(level, check, detail): no shared column is an issue; one-sided columns, types and small sides are warnings."""
    left, right = dict(ref.dtypes), dict(cur.dtypes)
    shared = [c for c in left if c in right]
    notes = [] if shared else [("issue", "no_common_columns", "")]
    notes += [("warning", "only_in_reference", c) for c in left if c not in right]
    notes += [("warning", "only_in_current", c) for c in right if c not in left]
    notes += [("warning", "different_types", f"{c}: {left[c]} vs {right[c]}") for c in shared if left[c] != right[c]]
    out = local_table(ref.sparkSession, notes, "level string, check string, detail string")
    for name, df in (("small_reference", ref), ("small_current", cur)):
        # Counting past the limit is not needed, so at most ``min_rows`` rows are read.
        size = df.limit(min_rows).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_rows)
        out = out.unionByName(size.select(F.lit("warning").alias("level"), F.lit(name).alias("check"), F.col("n").cast("string").alias("detail")))
    return out


def prediction_change(sided: DataFrame, column: str) -> DataFrame:
    """Level and spread of a prediction per side, their change, KS, and a reading of it."""
    long_df = S.long_numeric(sided, [column])
    limits = S.slot_limits(long_df)
    medians = S.exact_quantiles(
        long_df, [0.5], ["feature", "side"], limits
    ).groupBy("feature").agg(
        F.max(F.when(F.col("side") == "ref", F.col("quantile"))).alias("median_ref"),
        F.max(F.when(F.col("side") == "cur", F.col("quantile"))).alias("median_cur"),
    )

    def on(side: str, agg, name: str) -> Column:
        return agg(F.when(F.col("side") == side, F.col("value"))).alias(f"{name}_{side}")

    stats = long_df.groupBy("feature").agg(
        *[
            on(s, f, n)
            for s in ("ref", "cur")
            for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))
        ]
    )
    ranks = kolmogorov_smirnov(rank_statistics(ecdf(S.value_counts_by_side(long_df), limits)))
    ks = ranks.select("feature", F.col("ks").alias("ks_statistic"), F.col("ks_p").alias("ks_p_value"))
    moved = F.coalesce(F.try_divide(F.col("mean_shift"), F.col("mean_ref")), F.lit(0.0))
    notes = F.concat_ws(
        ";",
        F.when(F.col("mean_shift") > 0.1, "mean_increased").when(F.col("mean_shift") < -0.1, "mean_decreased"),
        F.when(F.col("std_ratio") > 1.2, "spread_increased").when(F.col("std_ratio") < 0.8, "spread_decreased"),
        F.when(F.col("ks_p_value") < 0.05, "confirmed_by_test"),
    )
    reading = F.when(notes == "", "stable").otherwise(notes)
    return (
        stats.join(medians, "feature")
        .join(ks, "feature")
        .withColumn("mean_shift", F.col("mean_cur") - F.col("mean_ref"))
        .withColumn("std_ratio", F.coalesce(F.try_divide(F.col("std_cur"), F.col("std_ref")), F.lit(0.0)))
        .withColumn("relative_change", moved)
        .withColumn("interpretation", reading)
    )


def monitor_drift(report: DataFrame, method: str, threshold: float = 0.1) -> DataFrame:
    """One method over all features: mean statistic against a threshold."""
    return report.where(F.col("method") == method).agg(
        F.coalesce(F.avg("statistic"), F.lit(0.0)).alias("drift_score"), F.count(F.lit(1)).alias("features")
    ).withColumn("drift_detected", F.col("drift_score") > threshold)


def performance_drift(ref_metrics: DataFrame, cur_metrics: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Mean relative change over the metrics both sides report: tables (metric, value)."""
    joined = ref_metrics.select("metric", F.col("value").alias("r")).join(
        cur_metrics.select("metric", F.col("value").alias("c")), "metric"
    )
    moved = F.coalesce(F.try_divide(F.abs(F.col("c") - F.col("r")), F.abs(F.col("r"))), F.abs(F.col("c")))
    return joined.agg(
        F.coalesce(F.avg(moved), F.lit(0.0)).alias("performance_drift"), F.count(F.lit(1)).alias("metrics")
    ).withColumn("drift_detected", F.col("performance_drift") > threshold)


def drift_trend(history: DataFrame) -> DataFrame:
    """Per model, from rows (model_id, ts, drift_score, drift_detected): latest state and how often it drifted.

    Of rows at one time the one with the higher score counts as the latest.
    """
    latest = F.max(F.struct("ts", "drift_score", "drift_detected"))
    return history.groupBy("model_id").agg(
        F.when(latest["drift_detected"], "drift_detected").otherwise("stable").alias("current_status"),
        F.count_if("drift_detected").alias("drift_events"),
        (F.count_if("drift_detected") / F.count(F.lit(1))).alias("drift_frequency"),
        latest["drift_score"].alias("latest_score"),
    )


def dashboard_stats(alerts: DataFrame, report: DataFrame) -> DataFrame:
    """Open critical and high alerts beside the drifting features and their mean score."""
    open_rows = alerts.where(~F.col("acknowledged")).agg(
        F.count_if(F.col("severity") == "critical").alias("critical_open"),
        F.count_if(F.col("severity") == "high").alias("high_open"),
    )
    features = feature_scores(report).agg(
        F.count_if("drift_detected").alias("drifting_features"), F.avg("drift_score").alias("mean_score")
    )
    one = F.lit(1)
    return (
        open_rows.withColumn("_k", one).join(features.withColumn("_k", one), "_k").drop("_k")
    )


def adversarial_accuracy(sided: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How well a logistic model tells the sides apart on rows it was not fitted on: AUC 0.5 means no drift, 1 complete drift.

    A missing value takes its column's mean and sets a flag of its own; three tenths of the rows, by hash, are held out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    # Five passes read the rows: the source, which may be a join, is read once.
    kept = materialise(sided.select(F.when(F.col("side") == "cur", 1.0).otherwise(0.0).alias("label"), *columns))
    means = kept.agg(*[F.coalesce(F.avg(S.clean(c)), F.lit(0.0)).alias(c) for c in columns]).first()
    rows = kept.select(
        "label",
        F.pmod(F.xxhash64(*columns), F.lit(10)).alias("_part"),
        *[F.coalesce(S.clean(c), F.lit(means[c])).alias(c) for c in columns],
        *[F.when(S.clean(c).isNull(), 1.0).otherwise(0.0).alias(f"_missing_{c}") for c in columns],
    )
    inputs = [*columns, *[f"_missing_{c}" for c in columns]]
    vectors = VectorAssembler(inputCols=inputs, outputCol="raw").transform(rows)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors.where("_part < 7"))
    scaled = scaler.transform(vectors)
    model = LogisticRegression(maxIter=20).fit(scaled.where("_part < 7"))
    auc = BinaryClassificationEvaluator().evaluate(model.transform(scaled.where("_part >= 7")))
    return local_table(sided.sparkSession,
        [("adversarial_accuracy", float(auc), float(abs(auc - 0.5) * 2))], "method string, auc double, score double"
    )
