"""Nearest rows against all pairs, and synthetic rows between them."""

import math
import random

import pytest

from tallywatch.operators import neighbours
from tallywatch.operators.neighbours import nearest_rows
from tallywatch.operators.preprocess import smote


def brute(rows, k):
    fine = [(g, i, x) for g, i, x in rows if g is not None and i is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = {}
    for g, i, x in fine:
        others = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), j) for h, j, y in fine if h == g and j != i)
        out[(g, i)] = others[:k]
    return out


def check(spark, rows, k):
    df = spark.createDataFrame([(g, i, *x, "c") for g, i, x in rows], "grp string, id long, a double, b double, x string")
    got = {(r.grp, r.id): [(n.far, n.key) for n in r.near] for r in nearest_rows(df, "grp", "id", ["a", "b"], k).collect()}
    want = brute(rows, k)
    assert set(got) == set(want)
    for key, hits in want.items():
        assert [i for _, i in got[key]] == [i for _, i in hits] and [f for f, _ in got[key]] == pytest.approx([f for f, _ in hits])


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(neighbours, "CELL", [20, 50, 1000][seed])
    monkeypatch.setattr(neighbours, "BLOCK", [16, 2048, 30][seed])
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        centre = rng.choice([(0, 0), (5, 5), (5, 5.5), (100, -40)])
        rows.append((rng.choice("uvv"), i, (rng.gauss(centre[0], 1), rng.choice([rng.gauss(centre[1], 1), float(centre[1])]))))
    check(spark, rows, 5)


def test_ties_copies_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    # A third of all rows are one point; a grid is full of ties.
    rows = [("g", i, (1.0, 1.0)) for i in range(60)] + [("g", 100 + i, (float(i % 8), float(i // 8))) for i in range(120)]
    rows += [("g", 300, (None, 1.0)), ("g", 301, (float("nan"), 1.0)), (None, 302, (1.0, 1.0)), ("one", 303, (1.0, 1.0)), ("two", 304, (0.0, -0.0)), ("two", 305, (-0.0, 0.0))]
    check(spark, rows, 4)
    empty = spark.createDataFrame([], "grp string, id long, a double, b double")
    assert nearest_rows(empty, "grp", "id", ["a", "b"], 3).count() == 0


def test_new_rows_fill_up_the_classes(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), "big" if i % 10 else "small") for i in range(300)] + [(900, 1.0, None, "small"), (901, 5.0, 5.0, "lonely"), (902, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y string")
    made = smote(df, "id", ["a", "b"], "y").collect()
    at = {r[0]: r for r in rows}
    assert {r.y for r in made} == {"small"} and len(made) == 270 - 31
    per_source = {}
    for r in made:
        s, n = at[r.source], at[r.neighbour]
        assert s[3] == n[3] == "small" and r.source not in (900, r.neighbour)
        per_source[r.source] = per_source.get(r.source, 0) + 1
        gap = (r.a - s[1]) / (n[1] - s[1])
        assert -1e-9 <= gap <= 1 + 1e-9 and r.b == pytest.approx(s[2] + gap * (n[2] - s[2]))
    assert set(per_source.values()) <= {239 // 30, 239 // 30 + 1} and len(per_source) == 30
    assert smote(df, "id", ["a", "b"], "y", sampling_strategy={"small": 40}).count() == 9
    assert smote(df.where("y = 'big'"), "id", ["a", "b"], "y").count() == 0
