"""Nearest vectors against all pairs, and the parts of the router."""

import numpy as np
import pytest

from tallywatch.llm import nearest
from tallywatch.llm.nearest import balanced_parts, fit, nearest_vectors, neighbours

SCHEMA = "vec_id long, embedding array<double>, rank string, hits long"


def brute(rows, asked, k):
    """query -> [(vec_id, score)], equal rows once."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in {(i, tuple(v)) for i, v in asked if (i, tuple(v or ())) in usable}:
        scored = [(-sum(np.multiply(v, w)) + 0.0, i) for i, w in usable if len(w) == len(v) and (i, w) != (q, v)]
        out.setdefault(q, []).append([(i, -s) for s, i in sorted(scored)[:k]])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "r", 1) for i, v in rows], SCHEMA)


def test_odd_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0]), (4, [-1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]),
            (10, [float("inf"), 1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [3.0, -0.0]), (13, [3.0, 0.0]), (2, [0.0, 1.0]), (0, [2.0, 2.0]), (14, [1.0, 0.0, 0.5])]
    docs = table(spark, rows)
    for k in (1, 50):
        got, want = found(nearest_vectors(docs, docs, k)), brute(rows, rows, k)
        assert set(got) == {q for q, lists in want.items() if any(lists)}
        for q, lists in want.items():
            assert sorted((i, s) for _, i, s in got[q]) == sorted(pair for one in lists for pair in one), (k, q)
    assert nearest_vectors(docs.limit(0), docs.limit(0)).count() == 0 and nearest_vectors(docs, docs.limit(0)).count() == 0
    assert nearest_vectors(docs.where("vec_id IN (5, 7)"), docs).count() == 0


def test_recall_and_exact_scores(spark, monkeypatch):
    # Many parts, small blocks, vectors of different lengths.
    monkeypatch.setattr(nearest, "ROWS", 64)
    monkeypatch.setattr(nearest, "BLOCK", 100)
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((40, 16)) * 2
    x = (middles[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))) * rng.uniform(0.5, 1.5, (4000, 1))
    vectors = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = found(nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"), sample=2048))
    hit = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {i for _, i, _ in got[q]})
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert np.allclose([v for _, _, v in got[q]], [s[i] for _, i, _ in got[q]], rtol=1e-12, atol=1e-12)
        assert [(-v, i) for _, i, v in got[q]] == sorted((-v, i) for _, i, v in got[q])
    assert hit / (200 * 20) >= 0.9


def test_half_is_one_vector(spark, monkeypatch):
    # One part, so that nothing is missed.
    monkeypatch.setattr(nearest, "ROWS", 10_000)
    monkeypatch.setattr(nearest, "BLOCK", 300)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 3000, 2)] + [(i, rng.standard_normal(3).tolist()) for i in range(1, 3000, 2)]
    docs = table(spark, rows)
    asked = [r for r in rows if r[0] % 50 in (0, 5)]
    got, want = found(nearest_vectors(docs, docs.where("vec_id % 50 IN (0, 5)"))), brute(rows, asked, 20)
    assert {q: [i for _, i, _ in hits] for q, hits in got.items()} == {q: [i for i, _ in lists[0]] for q, lists in want.items()}


@pytest.mark.parametrize("parts", [1, 2, 7, 16])
def test_parts_are_balanced_and_follow_the_graph(parts):
    rng = np.random.default_rng(parts)
    x = rng.standard_normal((16, 8))[rng.integers(0, 16, 1200)] * 3 + rng.standard_normal((1200, 8))
    graph = neighbours(x, x, 10, True)
    label = balanced_parts(graph, parts)
    sizes = np.bincount(label, minlength=parts)
    assert len(sizes) == parts and sizes.max() <= np.ceil(1200 / parts * 1.05) + 1 and sizes.min() >= 1200 / parts * 0.9 - 1
    kept = (label[graph] == label[:, None]).mean()
    assert kept >= (0.5 if parts > 1 else 1.0)


def test_router_beats_chance():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8, 12))[rng.integers(0, 8, 2000)] * 3 + rng.standard_normal((2000, 12))
    router = fit(x, 8)
    p = router.scores(x)
    assert np.allclose(p.sum(1), 1) and (p.max(1) > 0.5).mean() > 0.8 and 0 <= router.mass <= 1
    q, part = router.routes(x)
    assert len(q) < 0.7 * 8 * 2000 and set(q) == set(range(2000)) and part.max() < 8
    assert fit(x[:3], 4).routes(x[:3])[0].tolist() == [0, 1, 2]
    assert fit(np.ones((200, 4)), 4).parts(np.ones((2, 4))).tolist()[0] >= 0
