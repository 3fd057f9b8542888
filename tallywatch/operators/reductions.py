"""Fair classifiers by reductions (Agarwal et al. 2018): a game between multipliers of group constraints and a learner.

A constraint says how far the selection rate of a group (for equalized odds: of a group's rows of one
label) lies from that of all rows. Every row's cost of being selected depends only on its group and label, so a round is one cost per
such cell, and a learner's answer to it. The result is a mixture of the answers, a table of expressions, not of models to ship.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.session import local_table

Cell = tuple[str, int]

CONSTRAINTS = ("demographic_parity", "equalized_odds")


def _by_cell(group: str, values: dict[Cell, float]) -> Column:
    """A number per row by its group and label."""
    table = F.create_map(*[F.lit(v) for (g, y), x in values.items() for v in (f"{g}|{y}", float(x))])
    return F.try_element_at(table, F.concat_ws("|", F.col(group).cast("string"), F.col("y").cast("int").cast("string")))


class ThresholdLearner:
    """Rules "score of at least a threshold", one threshold for all or one per group, on a grid of ``bins`` steps of [0, 1].

    One scan counts rows per step, group and label; every answer after it is exact and reads no row.
    """

    def __init__(self, score: str = "p", bins: int = 100, per_group: bool = True):
        self.score, self.bins, self.per_group = score, bins, per_group

    def step(self) -> Column:
        return F.least(F.floor(F.greatest(F.col(self.score), F.lit(0.0)) * self.bins), F.lit(self.bins)).cast("int")

    def open(self, rows: DataFrame, group: str) -> None:
        self.group = group
        self.counts: dict[Cell, list[int]] = {}
        # At most a row per step, group and label.
        for r in rows.groupBy(F.col(group).cast("string").alias("g"), F.col("y").cast("int").alias("y"), F.coalesce(self.step(), F.lit(-1)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            self.counts.setdefault((r.g, r.y), [0] * (self.bins + 2))[r.b + 1] += r.n

    def answer(self, cost: dict[Cell, float]) -> tuple[Column, dict[Cell, float]]:
        above = {c: list(itertools.accumulate(reversed(n[1:])))[::-1] + [0] for c, n in self.counts.items()}

        def best(groups: Sequence[str]) -> int:
            sums = [round(sum(cost[c] * n[b] for c, n in above.items() if c[0] in groups), 9) for b in range(self.bins + 2)]
            return sums.index(min(sums))

        groups = sorted({g for g, _ in self.counts})
        limits = {g: best([g]) for g in groups} if self.per_group else dict.fromkeys(groups, best(groups))
        limit = F.create_map(*[F.lit(v) for item in limits.items() for v in item])
        rule = F.coalesce(self.step() >= F.try_element_at(limit, F.col(self.group).cast("string")), F.lit(False)).cast("double")
        return rule, {c: float(n[limits[c[0]]]) for c, n in above.items()}


class LogisticLearner:
    """Logistic regressions on features: a weighted fit, and a scan that counts its selections, per round."""

    def __init__(self, features: Sequence[str], max_iter: int = 30):
        self.features, self.max_iter = list(features), max_iter

    def open(self, rows: DataFrame, group: str) -> None:
        from pyspark.ml.feature import VectorAssembler

        self.group = group
        self.rows = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="skip").transform(rows.select("y", group, *[F.col(f).cast("double").alias(f) for f in self.features]))

    def answer(self, cost: dict[Cell, float]) -> tuple[Column, dict[Cell, float]]:
        from pyspark.ml.classification import LogisticRegression

        wanted = {c: float(x < 0) for c, x in cost.items()}
        if len(set(wanted.values())) == 1:
            line = F.lit(1.0 if 1.0 in wanted.values() else -1.0)
        else:
            signed = _by_cell(self.group, cost)
            fit = LogisticRegression(labelCol="_label", weightCol="_weight", maxIter=self.max_iter).fit(self.rows.withColumns({"_label": (signed < 0).cast("double"), "_weight": F.abs(signed)}))
            line = sum((F.col(f).cast("double") * float(w) for f, w in zip(self.features, fit.coefficients)), F.lit(float(fit.intercept)))
        rule = F.coalesce(line > 0, F.lit(False)).cast("double")
        sums = self.rows.groupBy(F.col(self.group).cast("string").alias("g"), F.col("y").cast("int").alias("y")).agg(F.sum(rule).alias("s")).collect()
        return rule, {c: next((r.s for r in sums if (r.g, r.y) == c), 0.0) for c in cost}


class Mixture:
    """A classifier that is one of several rules, each with its chance."""

    def __init__(self, rules: Sequence[tuple[float, Column]]):
        self.rules = list(rules)

    def score(self, df: DataFrame, name: str = "chance") -> DataFrame:
        """``df`` with the chance of every row to be selected."""
        return df.withColumn(name, sum((rule * w for w, rule in self.rules), F.lit(0.0)))

    def decide(self, df: DataFrame, key: Sequence[str], name: str = "mitigated", seed: int = 42) -> DataFrame:
        """``df`` with a 0/1 decision per row, drawn by a hash of its key."""
        from tallywatch.operators.summaries import hash_unit

        return self.score(df, "_chance").withColumn(name, (hash_unit(str(seed), *[F.col(k) for k in key]) < F.col("_chance")).cast("int")).drop("_chance")


class Game:
    """The cells of a table, the constraints between them, and a learner that answers multipliers.

    Rows without a group or a label take no part in the fit; a constraint is named by its group, for equalized odds by its cell.
    """

    def __init__(self, df: DataFrame, group: str, learner, constraint: str = "demographic_parity"):
        if constraint not in CONSTRAINTS:
            raise ValueError(f"unknown constraint: {constraint}")
        rows = df.where(F.col(group).isNotNull() & F.col("y").isNotNull())
        table = rows.groupBy(F.col(group).cast("string").alias("g"), F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
        self.cells: dict[Cell, int] = {(r.g, r.y): r.n for r in table}
        self.total = sum(self.cells.values())
        self.odds = constraint == "equalized_odds"
        self.names = sorted(self.cells) if self.odds else sorted({g for g, _ in self.cells})
        self.group, self.learner = group, learner
        learner.open(rows, group)

    def _of(self, cell: Cell):
        return cell if self.odds else cell[0]

    def _size(self, name) -> int:
        return sum(n for c, n in self.cells.items() if self._of(c) == name)

    def _about(self, name) -> int:
        """Rows that a constraint compares with."""
        return sum(n for c, n in self.cells.items() if not self.odds or c[1] == name[1])

    def costs(self, multipliers: dict) -> dict[Cell, float]:
        """What selecting a row costs more than not selecting it: its error and its part in the constraints."""
        out = {}
        for g, y in self.cells:
            name = self._of((g, y))
            own = multipliers[name] * self.total / self._size(name)
            shared = sum(multipliers[m] * self.total / self._about(m) for m in self.names if not self.odds or m[1] == y)
            out[g, y] = 1 - 2 * y + own - shared
        return out

    def answer(self, multipliers: dict) -> tuple[Column, dict[Cell, float]]:
        return self.learner.answer(self.costs(multipliers))

    def error(self, selected: dict[Cell, float]) -> float:
        return sum(self.cells[g, y] - s if y == 1 else s for (g, y), s in selected.items()) / self.total

    def violations(self, selected: dict[Cell, float]) -> dict:
        """Per constraint the selection rate of its rows less that of the rows it compares with."""
        out = {}
        for name in self.names:
            own = sum(s for c, s in selected.items() if self._of(c) == name) / self._size(name)
            out[name] = own - sum(s for c, s in selected.items() if not self.odds or c[1] == name[1]) / self._about(name)
        return out

    def difference(self, selected: dict[Cell, float]) -> float:
        """The widest gap between the rates of two groups."""
        gaps = self.violations(selected)
        labels = {n[1] for n in self.names} if self.odds else {None}
        return max((max(v) - min(v) for v in ([x for n, x in gaps.items() if not self.odds or n[1] == y] for y in labels) if v), default=0.0)


def exponentiated_gradient(
    df: DataFrame, group: str, learner, constraint: str = "demographic_parity", rounds: int = 50, slack: float = 0.01, bound: float | None = None, step: float = 2.0
) -> tuple[Mixture, DataFrame, float]:
    """(mixture, history, gap): an even mixture of the learner's answers to multipliers moved by exponentiated gradient.

    Every constraint has a multiplier for either direction; together they are at most ``bound``, by default 1 / ``slack``.
    History: (round, name, multiplier, violation, error). ``gap`` is how far the mixture and the mean multipliers are from the
    saddle point; violations of the mixture are at most ``slack`` + (1 + ``gap``) / ``bound``.
    """
    game = Game(df, group, learner, constraint)
    bound = bound or 1 / slack
    up, down = dict.fromkeys(game.names, 0.0), dict.fromkeys(game.names, 0.0)
    rules, history = [], []
    chosen = dict.fromkeys(game.cells, 0.0)
    mean = dict.fromkeys(game.names, 0.0)
    for i in range(rounds if game.names else 0):
        # Shifted by the largest, so that no exponential overflows.
        top = max(0.0, *up.values(), *down.values())
        total = math.exp(-top) + sum(math.exp(x - top) for x in (*up.values(), *down.values()))
        multipliers = {n: bound * (math.exp(up[n] - top) - math.exp(down[n] - top)) / total for n in game.names}
        rule, selected = game.answer(multipliers)
        rules.append(rule)
        gaps = game.violations(selected)
        for n in game.names:
            history.append((i, "|".join(map(str, n)) if game.odds else n, multipliers[n], gaps[n], game.error(selected)))
            up[n] += step / bound * (gaps[n] - slack)
            down[n] += step / bound * (-gaps[n] - slack)
            mean[n] += multipliers[n] / rounds
        for c in chosen:
            chosen[c] += selected[c] / rounds
    gap = 0.0
    if game.names:
        worst = max(max(abs(v) for v in game.violations(chosen).values()) - slack, 0.0)
        _, best = game.answer(mean)
        lower = game.error(best) + sum(mean[n] * v - abs(mean[n]) * slack for n, v in game.violations(best).items())
        gap = game.error(chosen) + bound * worst - lower
    table = local_table(df.sparkSession, history, "round int, name string, multiplier double, violation double, error double")
    return Mixture([(1 / len(rules), r) for r in rules]), table, gap


def multiplier_grid(names: Sequence, size: int = 10, limit: float = 2.0) -> list[dict]:
    """At least ``size`` multiplier vectors: whole-number vectors of small absolute sum, scaled to ``limit``."""
    for units in itertools.count(1):
        points = [v for v in itertools.product(range(-units, units + 1), repeat=len(names)) if sum(map(abs, v)) <= units]
        if len(points) >= size:
            return [{n: limit * x / units for n, x in zip(names, v)} for v in points]


def reduction_grid(df: DataFrame, group: str, learner, constraint: str = "demographic_parity", size: int = 10, limit: float = 2.0, weight: float = 0.5) -> tuple[Mixture, DataFrame]:
    """(best, table): the learner's answer to every point of a grid of multipliers; one constraint per group, all groups.

    Table: (point, multipliers as a map, accuracy, difference, objective), the best first; the objective
    weighs the error by 1 - ``weight`` and the widest gap between groups by ``weight``.
    """
    game = Game(df, group, learner, constraint)
    rows, rules = [], []
    for i, multipliers in enumerate(multiplier_grid(game.names, size, limit) if game.names else ()):
        rule, selected = game.answer(multipliers)
        error, gap = game.error(selected), game.difference(selected)
        rules.append(rule)
        rows.append((i, ["|".join(map(str, n)) if game.odds else n for n in multipliers], list(multipliers.values()), 1 - error, gap, (1 - weight) * error + weight * gap))
    table = local_table(df.sparkSession, rows, "point int, names array<string>, multipliers array<double>, accuracy double, difference double, objective double")
    best = min(rows, key=lambda r: (round(r[5], 12), r[0]))[0] if rows else None
    mixed = Mixture([(1.0, rules[best])] if rows else [])
    return mixed, table.select("point", F.map_from_arrays("names", "multipliers").alias("multipliers"), "accuracy", "difference", "objective").orderBy("objective", "point")
