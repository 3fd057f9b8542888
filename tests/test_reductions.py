"""The fairness game: three groups, both constraints, both learners."""

import random

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import reductions as R


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        g = rng.choice(["a", "a", "b", "c"])
        x = rng.gauss({"a": 1.0, "b": 0.0, "c": -0.5}[g], 1.0)
        rows.append((i, g, int(x + rng.gauss(0, 0.7) > 0.4), min(max(x / 6 + 0.5, 0.0), 1.0), x, float(g == "b"), float(g == "c")))
    rows += [(9000, None, 1, 0.5, 0.1, 0.0, 0.0), (9001, "a", None, 0.5, 0.1, 0.0, 0.0)]
    return spark.createDataFrame(rows, "id long, grp string, y int, p double, x double, is_b double, is_c double")


def rates(df, keys=("grp",)):
    return {tuple(r[k] for k in keys): r.s for r in df.where("grp IS NOT NULL AND y IS NOT NULL").groupBy(*keys).agg(F.avg("chance").alias("s")).collect()}


@pytest.mark.parametrize("per_group", [True, False])
def test_parity_by_thresholds(people, per_group):
    slack = 0.02
    mixture, history, gap = R.exponentiated_gradient(people, "grp", R.ThresholdLearner("p", 100, per_group), rounds=60, slack=slack)
    found = rates(mixture.score(people))
    assert len(found) == 3 and history.count() == 180
    total = people.where("grp IS NOT NULL AND y IS NOT NULL").count()
    sizes = {(r.grp,): r["count"] for r in people.where("grp IS NOT NULL AND y IS NOT NULL").groupBy("grp").count().collect()}
    overall = sum(found[g] * sizes[g] for g in found) / total
    worst = max(abs(s - overall) for s in found.values())
    assert worst <= slack + (1 + max(gap, 0)) * slack and gap < 0.5
    assert abs(sum(w for w, _ in mixture.rules) - 1) < 1e-9


def test_parity_by_regressions(people):
    before, _, _ = R.exponentiated_gradient(people, "grp", R.LogisticLearner(["x", "is_b", "is_c"]), rounds=1)
    mixture, _, _ = R.exponentiated_gradient(people, "grp", R.LogisticLearner(["x", "is_b", "is_c"], max_iter=10), rounds=8, slack=0.05, step=8.0)
    wide, narrow = rates(before.score(people)), rates(mixture.score(people))
    spread = lambda r: max(r.values()) - min(r.values())
    assert spread(wide) > 0.3 and spread(narrow) < spread(wide) / 2
    decided = mixture.decide(people, ["id"]).agg(F.avg("mitigated").alias("m")).first().m
    assert abs(decided - mixture.score(people).agg(F.avg("chance").alias("m")).first().m) < 0.05


def test_odds(people):
    learner = R.ThresholdLearner("p", 100)
    mixture, history, _ = R.exponentiated_gradient(people, "grp", learner, "equalized_odds", rounds=60, slack=0.02)
    found = rates(mixture.score(people), ("y", "grp"))
    for y in (0, 1):
        of = [s for (label, _), s in found.items() if label == y]
        assert len(of) == 3 and max(of) - min(of) < 0.12
    assert {r.name for r in history.select("name").distinct().collect()} == {f"{g}|{y}" for g in "abc" for y in (0, 1)}


def test_grid_holds_every_group(people):
    best, table = R.reduction_grid(people, "grp", R.ThresholdLearner("p", 50), size=30)
    rows = table.collect()
    assert len(rows) >= 30 and all(set(r.multipliers) == {"a", "b", "c"} for r in rows)
    assert [r.objective for r in rows] == sorted(r.objective for r in rows)
    free = next(r for r in rows if not any(r.multipliers.values()))
    assert rows[0].difference < free.difference and rows[0].accuracy <= free.accuracy
    found = rates(best.score(people))
    assert max(found.values()) - min(found.values()) == pytest.approx(rows[0].difference)


def test_tables_without_groups(people):
    empty = people.limit(0)
    mixture, table = R.reduction_grid(empty, "grp", R.ThresholdLearner())
    assert table.count() == 0 and mixture.score(people).agg(F.sum("chance")).first()[0] == 0
    with pytest.raises(ValueError):
        R.Game(people, "grp", R.ThresholdLearner(), "no such rule")
