"""Shared summaries every statistic is built from.

* long form: ``(keys..., feature, value)``, one row per non-null cell;
* slots: an ordered, balanced cut of each feature's range, used to spread ordered
  work (cumulative sums, quantiles, ranks) over many tasks;
* cumulative counts: the empirical distribution function, without ever sorting a
  whole column in one task.

Slot limits are estimates and steer only the balance of the work: every result is
exact whatever the limits are. They are fetched once as plain numbers (like the
bounds of a range shuffle), so both halves of a plan and every retry of a lost task
see the same cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallywatch.session import local_table, materialise, stored_size

SLOTS = 1024


def clean(name: str) -> Column:
    """A numeric column as double with NaN read as missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def numeric_columns(df: DataFrame) -> list[str]:
    wanted = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in wanted or t.startswith("decimal")]


def categorical_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("string", "boolean")]


def long_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("side",)) -> DataFrame:
    wide = df.select(*keep, *[clean(c).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "feature", "value").where(F.col("value").isNotNull())


def long_categorical(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("side",)) -> DataFrame:
    wide = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "feature", "value").where(F.col("value").isNotNull())


def pair_sides(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Reference and current rows under one ``side`` column, shared columns only."""
    shared = [c for c in ref.columns if c in set(cur.columns)]
    if not shared:
        raise ValueError("the two tables share no column")
    return ref.select(F.lit("ref").alias("side"), *shared).unionByName(
        cur.select(F.lit("cur").alias("side"), *shared)
    )


def slot_limits(long_df: DataFrame, value: str = "value") -> DataFrame:
    """(feature, limits): estimated quantiles of every feature, ``SLOTS`` even parts, as a local table."""
    shares = [i / SLOTS for i in range(SLOTS + 1)]
    rows = (
        long_df.groupBy("feature")
        .agg(F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), 3 * SLOTS).alias("limits"))
        .collect()
    )
    data = [(r["feature"], [float(x) for x in r["limits"]]) for r in rows]
    return local_table(long_df.sparkSession, data, "feature string, limits array<double>")


def with_slot(long_df: DataFrame, limits: DataFrame, value: str = "value") -> DataFrame:
    """Add ``slot``: order-preserving in ``value``, about the same number of rows in each.

    The limits are quantiles, so a far value has no say in the others' slots. The slot is found by
    ten halving steps, all plain column arithmetic.
    """
    v = F.col(value)
    out = long_df.join(F.broadcast(limits), "feature").withColumn("slot", F.lit(0))
    step = SLOTS // 2
    while step:
        ahead = F.get(F.col("limits"), F.col("slot") + F.lit(step))
        # The otherwise makes the slot non-null, which spares joins on it a repeated null check.
        out = out.withColumn("slot", F.col("slot") + F.when(v >= ahead, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return out.drop("limits")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` stored in range parts of ``order``, with the number of its part as ``slot``.

    Parts are even unless rows are equal in all of ``order``, and follow the amount of data. They are
    written, so that every later reader and every retry sees the same cut.
    """
    return materialise(df.repartitionByRange(*order).withColumn("slot", F.spark_partition_id()))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join by ``on`` in which null meets null; the left table's keys are kept."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, test, how).drop(*[f"_r_{c}" for c in on])


def as_counts(long_df: DataFrame, *keep: str) -> DataFrame:
    """Rows in the shape of V with counts of 0 and 1: what the methods below read when V is not worth building."""
    return long_df.select(
        "feature",
        *keep,
        "value",
        F.when(F.col("side") == "ref", 1).otherwise(0).cast("bigint").alias("c_ref"),
        F.when(F.col("side") == "cur", 1).otherwise(0).cast("bigint").alias("c_cur"),
    )


def value_counts_by_side(long_df: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """V: (keys, value, c_ref, c_cur); hot values collapse before the shuffle."""
    return long_df.groupBy(*keys, "value").agg(
        F.count_if(F.col("side") == "ref").alias("c_ref"),
        F.count_if(F.col("side") == "cur").alias("c_cur"),
    )


def cumulative(
    counts: DataFrame,
    measures: Sequence[str],
    limits: DataFrame,
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    few_keys: bool = True,
) -> DataFrame:
    """Running sums of ``measures`` over ``value`` within ``keys``.

    Adds ``before_<m>`` (sum over smaller values), ``total_<m>`` and ``next_value``.
    Sums within a slot come from a window, sums of earlier slots from a table of slot
    totals (at most 1024 rows per key). ``few_keys`` says the keys are column names, so
    that this table is small enough to broadcast.
    """
    keys = list(keys)
    slotted = with_slot(counts, limits, value)
    by_slot = Window.partitionBy(*keys).orderBy("slot")
    whole = Window.partitionBy(*keys)
    totals = slotted.groupBy(*keys, "slot").agg(
        *[F.sum(m).alias(f"_s_{m}") for m in measures], F.min(value).alias("_first")
    )
    offsets = totals.select(
        *keys,
        "slot",
        *[(F.sum(f"_s_{m}").over(by_slot) - F.col(f"_s_{m}")).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"total_{m}") for m in measures],
        F.lead("_first").over(by_slot).alias("_next_first"),
    )
    inside = Window.partitionBy(*keys, "slot").orderBy(value)
    joined = slotted.join(F.broadcast(offsets) if few_keys else offsets, [*keys, "slot"])
    running = joined.select(
        *counts.columns,
        *[f"total_{m}" for m in measures],
        *[
            (F.col(f"_off_{m}") + F.sum(m).over(inside) - F.col(m)).alias(f"before_{m}")
            for m in measures
        ],
        F.coalesce(F.lead(value).over(inside), F.col("_next_first")).alias("next_value"),
    )
    return running


TARGETS = "array<struct<share:double,n:bigint,_pos:double,_low:bigint,_high:bigint>>"


def _few_targets(sizes: DataFrame, shares: Sequence[float], position: Callable[[float, int], float] | None) -> DataFrame:
    """Slots that hold a wanted position, per column name: at most 1024 counts per column are looked at here."""
    by_feature: dict[str, list[tuple[int, int]]] = {}
    for r in sizes.collect():
        by_feature.setdefault(r["feature"], []).append((r["slot"], r["_n"]))
    rows = []
    for feature, counts in by_feature.items():
        n, before = sum(c for _, c in counts), 0
        wanted = []
        for s in shares:
            at = float(position(s, n) if position else s * (n - 1))
            wanted.append((float(s), n, at, math.floor(at), math.ceil(at)))
        for slot, count in sorted(counts):
            here = [w for w in wanted if before <= w[3] < before + count or before <= w[4] < before + count]
            if here:
                rows.append((feature, slot, before, here))
            before += count
    return local_table(sizes.sparkSession, rows, f"feature string, slot int, _before bigint, _t {TARGETS}")


def _many_targets(sizes: DataFrame, shares: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The same for any number of groups, as a table."""
    by_slot = Window.partitionBy(*keys).orderBy("slot")
    located = sizes.withColumn("_before", F.sum("_n").over(by_slot) - F.col("_n")).withColumn(
        "n", F.sum("_n").over(Window.partitionBy(*keys))
    )
    inside = lambda c: F.col(c).between(F.col("_before"), F.col("_before") + F.col("_n") - 1)
    targets = (
        located.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .withColumn("_pos", F.col("share") * (F.col("n") - 1))
        .withColumns({"_low": F.floor("_pos"), "_high": F.ceil("_pos")})
        .where(inside("_low") | inside("_high"))
    )
    return targets.groupBy(*keys, "slot", "_before").agg(
        F.collect_list(F.struct("share", "n", "_pos", "_low", "_high")).alias("_t")
    )


def exact_quantiles(
    long_df: DataFrame,
    shares: Sequence[float],
    keys: Sequence[str] = ("feature",),
    limits: DataFrame | None = None,
    weight: str | None = None,
    position: Callable[[float, int], float] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: (keys, share, quantile, n).

    ``weight`` names a count column when the rows are already value counts. ``position`` maps
    (share, n) to a 0-based position, ``share * (n - 1)`` unless given (plain columns only).

    Two narrow passes: count rows per slot, then look only into the few slots that hold
    a wanted position. Nothing is sorted as a whole and no group is collected.
    """
    keys = list(keys)
    few_keys = keys == ["feature"]
    limits = limits if limits is not None else slot_limits(long_df)
    counted = F.lit(1) if weight is None else F.col(weight)
    slotted = with_slot(long_df.select(*keys, "value", counted.cast("bigint").alias("_w")).where("_w > 0"), limits)
    sizes = slotted.groupBy(*keys, "slot").agg(F.sum("_w").alias("_n"))
    packed = _few_targets(sizes, shares, position) if few_keys else _many_targets(sizes, shares, keys)
    inside = Window.partitionBy(*keys, "slot").orderBy("value")
    dense = (
        slotted.join(F.broadcast(packed.select(*keys, "slot")) if few_keys else packed.select(*keys, "slot"), [*keys, "slot"])
        .groupBy(*keys, "slot", "value")
        .agg(F.sum("_w").alias("_c"))
        .withColumn("_end", F.sum("_c").over(inside))
    )
    hit = dense.join(F.broadcast(packed) if few_keys else packed, [*keys, "slot"]).select(
        *keys, "value", (F.col("_before") + F.col("_end") - F.col("_c")).alias("_start"), (F.col("_before") + F.col("_end")).alias("_end"), F.inline("_t")
    )
    low = F.max(F.when((F.col("_low") >= F.col("_start")) & (F.col("_low") < F.col("_end")), F.col("value")))
    high = F.max(F.when((F.col("_high") >= F.col("_start")) & (F.col("_high") < F.col("_end")), F.col("value")))
    # A position between two slots gets one row from each, hence the final aggregate.
    return (
        hit.groupBy(*keys, "share", "n", "_pos", "_low")
        .agg(low.alias("_vl"), high.alias("_vh"))
        .select(
            *keys,
            "share",
            (F.col("_vl") + (F.col("_vh") - F.col("_vl")) * (F.col("_pos") - F.col("_low"))).alias("quantile"),
            "n",
        )
    )


def quantiles_wide(
    long_df: DataFrame, named: dict[str, float], keys: Sequence[str] = ("feature",), limits: DataFrame | None = None, weight: str | None = None
) -> DataFrame:
    """``exact_quantiles`` with one column per wanted quantile."""
    rows = exact_quantiles(long_df, sorted(set(named.values())), keys, limits, weight)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("share") == F.lit(float(s)), F.col("quantile"))).alias(n) for n, s in named.items()],
        F.max("n").alias("n"),
    )


#: Estimated quantiles miss their rank by at most one part in this many.
RANK_PARTS = 3 * SLOTS


def _brackets(shares: Sequence[float]) -> list[float]:
    """Per share one below and one above it, so far apart that estimates at them enclose the exact quantile."""
    return [min(1.0, max(0.0, s + d / RANK_PARTS)) for s in shares for d in (-2, 2)]


def first_look(df: DataFrame, columns: Sequence[str], shares: Sequence[float], *others: Column) -> tuple[list[Row], Row]:
    """One scan: per numeric column its moments and bounds of its quantiles; and what ``others`` aggregate.

    A row holds feature, n, mean, std, min, max and ``bounds``: for every share a value not above
    the exact quantile and one not below. Columns without values are left out.
    """
    wanted = F.array(*[F.lit(b) for b in _brackets(shares)])

    def look(c: str) -> Column:
        v = clean(c)
        return F.struct(
            F.lit(c).alias("feature"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.percentile_approx(v, wanted, RANK_PARTS).alias("bounds"),
        )

    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[look(c).alias(f"_look_{i}") for i, c in enumerate(columns)], *others).first()
    looks = [row[f"_look_{i}"] for i in range(len(columns))]
    return [r for r in looks if r["n"]], row


def fence_bounds(q1: tuple[float, float], q3: tuple[float, float], factor: float) -> list[tuple[float, float]]:
    """Bounds of both fences from bounds of the quartiles; rounding is monotone, so they hold to the last bit."""
    return [
        (q1[0] - factor * (q3[1] - q1[0]), q1[1] - factor * (q3[0] - q1[1])),
        (q3[0] + factor * (q3[0] - q1[1]), q3[1] + factor * (q3[1] - q1[0])),
    ]


def condensed(df: DataFrame, looks: Sequence[Row], shares: Sequence[float], fences: float | None = None) -> DataFrame:
    """A second scan that keeps of every column what exact quantiles need: (feature, value, n), stored.

    Values within the bounds of a wanted quantile stay as value counts, a few thousandths of the
    rows. Each stretch between bounds becomes one row, its least value with the number of its rows,
    so running counts are exact at every value that was kept. With ``fences``, a factor of the
    interquartile range for which ``shares`` begin with the quartiles, so do the values that might be on
    either side of a fence. Should a wanted position lie outside the bounds, the stretch it lies in is not
    condensed but all values are counted.
    """
    spark, rows = df.sparkSession, []
    for r in looks:
        pairs = list(zip(r["bounds"][::2], r["bounds"][1::2]))
        rows.append((r["feature"], *[float(x) for p in pairs + (fence_bounds(pairs[0], pairs[1], fences) if fences is not None else []) for x in p]))
    count = (len(rows[0]) - 1) // 2 if rows else 0
    bounds = local_table(spark, rows, "feature string" + "".join(f", _a{i} double, _b{i} double" for i in range(count)))
    v = F.col("value")

    def passed(test: Callable[[int], Column]) -> Column:
        return sum((F.when(test(i), 1).otherwise(0) for i in range(count)), F.lit(0))

    long_df = long_numeric(df, [r["feature"] for r in looks], keep=()) if looks else spark.range(0).select(F.lit("").alias("feature"), F.lit(0.0).alias("value"))
    placed = (
        long_df.join(F.broadcast(bounds), "feature")
        .withColumns({"_in": passed(lambda i: v >= F.col(f"_a{i}")), "_out": passed(lambda i: v > F.col(f"_b{i}"))})
        .withColumns({"_zone": F.col("_in") + F.col("_out"), "_kept": F.col("_in") > F.col("_out")})
    )
    table = materialise(
        placed.groupBy("feature", "_zone", "_kept", F.when(F.col("_kept"), v).alias("_v")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
    )
    zones: dict[str, list[Row]] = {}
    for z in table.groupBy("feature", "_zone", "_kept").agg(F.sum("n").alias("n")).collect():
        zones.setdefault(z["feature"], []).append(z)
    for found in zones.values():
        total, before = sum(z["n"] for z in found), 0
        places = {f(s * (total - 1)) for s in shares for f in (math.floor, math.ceil)}
        for z in sorted(found, key=lambda z: z["_zone"]):
            if not z["_kept"] and any(before <= p < before + z["n"] for p in places):
                return materialise(long_df.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
            before += z["n"]
    return table.select("feature", "value", "n")


def ordered_codes(values: DataFrame) -> DataFrame:
    """Add ``code``, the 0-based position of a text among its feature's distinct values.

    ``values`` holds each (feature, value) once. Positions are counted within range parts of the
    whole text, so a prefix that many texts share is no hot spot.
    """
    cells = in_order(values, "feature", "value")
    sizes = cells.groupBy("feature", "slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("feature").orderBy("slot")) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy("feature", "slot").orderBy("value"))
    joined = cells.join(sizes.select("feature", "slot", before.alias("_off")), ["feature", "slot"])
    return joined.withColumn("code", F.col("_off") + inside - 1).drop("slot", "_off")


BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A lookup table, broadcast if it has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes on disk.

    The table is worked out once, written and measured; a larger one joins from its files by shuffle.
    """
    table, rows, size = stored_size(df, "lookup")
    return F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over the shuffle partitions, whatever its keys and files.

    Input splits follow bytes, but the work on rows that are expanded or fitted follows their number.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_unit(seed: str, *parts: Column) -> Column:
    """A repeatable number in [0, 1) from a seed and key columns (same in any SQL engine with md5)."""
    text = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", spread: int = 64
) -> DataFrame:
    """The first ``k`` rows per key in ``order``; a hot key is first cut down in ``spread`` parts.

    ``order`` must be a total order within a key.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(spread))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= k)
        .drop("_r", "_part")
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= k)
    )


def hash_rank(df: DataFrame, seed: str, key: Sequence[str], within: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """1-based rank by ``md5(seed|key)`` within ``within``, spread over 4096 hash prefixes.

    A hash is even by construction, so prefixes are balanced parts that are already in order.
    """
    within = list(within)
    text = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key])
    hashed = df.withColumn("_h", F.md5(text)).withColumn("_prefix", F.substring("_h", 1, 3))
    sizes = hashed.groupBy(*within, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    by_prefix = Window.partitionBy(*within).orderBy("_prefix") if within else Window.partitionBy(F.lit(0)).orderBy("_prefix")
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *within,
        "_prefix",
        (F.sum("_n").over(by_prefix) - F.col("_n")).alias("_off"),
        F.sum("_n").over(whole).alias(f"{rank}_total"),
    )
    inside = Window.partitionBy(*within, "_prefix").orderBy("_h", *key)
    return (
        hashed.join(F.broadcast(offsets) if not within else offsets, [*within, "_prefix"])
        .withColumn(rank, F.col("_off") + F.row_number().over(inside))
        .drop("_h", "_prefix", "_off")
    )


def hash_text(seed: str, key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))


def hash_cuts(df: DataFrame, seed: str, key: Sequence[str], shares: Sequence[float], within: Sequence[str] = ()) -> DataFrame:
    """(within, share, cut): the hash of row number ``floor(n * share)`` in hash order.

    Comparing a row's own hash with the cut splits a table at exact sizes without moving rows.
    """
    within = list(within)
    hashed = df.select(*within, hash_text(seed, key).alias("_h")).withColumn("_prefix", F.substring("_h", 1, 3))
    by_prefix = Window.partitionBy(*within).orderBy("_prefix")
    sizes = (
        hashed.groupBy(*within, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(by_prefix))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*within)))
        .withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
        .withColumn("_at", F.floor(F.col("_total") * F.col("share") + 1e-9))
        .where((F.col("_at") > F.col("_end") - F.col("_n")) & (F.col("_at") <= F.col("_end")))
        .select(*within, "_prefix", "share", (F.col("_at") - F.col("_end") + F.col("_n")).alias("_nth"))
    )
    # One row per group and share: where these are few, the table does not move.
    sizes = broadcast_if_small(sizes)
    inside = Window.partitionBy(*within, "_prefix").orderBy("_h")
    ranked = null_safe_join(hashed, sizes.select(*within, "_prefix"), [*within, "_prefix"], "left_semi").withColumn(
        "_r", F.row_number().over(inside)
    )
    return null_safe_join(ranked, sizes, [*within, "_prefix"]).where("_r = _nth").select(*within, "share", F.col("_h").alias("cut"))
