import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tallywatch.llm import embedding, exact, graph, minhash


def test_exact(odd_docs, no_docs):
    rows = exact.exact_duplicates(odd_docs, salts=2).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {(r.keep_id, r.group_size) for d in (1, 2, None) for r in by[d]} == {(1, 3)}
    assert by[1][0].kept and not by[2][0].kept and not by[None][0].kept
    assert (by[3][0].keep_id, by[4][0].keep_id, by[4][0].group_size) == (3, 3, 2)  # null and empty
    assert [(r.keep_id, r.group_size, r.kept) for r in by[5]] == [(5, 2, True)] * 2
    assert by[2][0].text_sha256 == hashlib.sha256(b"Alpha beta gamma delta epsilon zeta eta theta.").hexdigest()
    assert by[6][0].keep_id == 6 and by[7][0].keep_id == 7
    assert exact.exact_duplicates(no_docs).count() == 0


def test_exact_compares_texts_that_share_a_digest(spark, odd_docs, monkeypatch):
    from pyspark.sql import functions as F

    real = exact.normalised
    monkeypatch.setattr(exact, "normalised", lambda docs: real(docs).withColumn("text_sha256", F.lit("same")))
    rows = {r.doc_id: r for r in exact.exact_duplicates(odd_docs.where("doc_id IN (1, 2, 6, 8)")).collect()}
    assert [(rows[d].keep_id, rows[d].group_size) for d in (1, 2, 6, 8)] == [(1, 2), (1, 2), (6, 1), (8, 1)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (4, 4), (20, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[3] == got[20] == 1 and got[9] == 7 and got[160] == 100 and 4 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts, percent=85):
    sets = {}
    for key, text in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and both:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(150)]
    texts, n = {}, 0
    for edits in [1, 2, 3, 4, 5, 6, 8] * 8:
        copy = list(base)
        for _ in range(edits):
            copy[r.randrange(len(copy))] = r.choice(words)
        texts[n] = " ".join(copy)
        n += 1
    passage = [r.choice(words) for _ in range(60)]
    for _ in range(40):
        texts[n] = " ".join([r.choice(words) for _ in range(r.randrange(5, 90))] + passage)
        n += 1
    texts |= {n: None, n + 1: "", n + 2: "a b", n + 3: "A\tb", n + 4: "a b c d e", n + 5: " ", n + 6: texts[3].upper()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in minhash.near_duplicates(docs).collect()}
    want = brute(texts)
    assert {k: (x.n_shingles, x.component_id) for k, x in got.items()} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and not by[2].kept and by[7].component_id == 6
    assert by[None].component_id is None and by[None].kept and by[3].n_shingles == 0 and by[3].kept
    assert minhash.near_duplicates(no_docs).count() == 0


def test_near_stage_links_from_080(spark):
    r = random.Random(8)
    texts = {}
    for n in range(120):
        base = [f"w{r.randrange(3000)}" for _ in range(104)]
        # 100 shingles each, 9, 10, 11 or 12 of them changed: similarities 0.835, 0.818, 0.802 and 0.786.
        changed = 9 + n % 4
        texts |= {2 * n: " ".join(base), 2 * n + 1: " ".join(base[:-changed] + [f"x{n}_{i}" for i in range(changed)])}
    texts |= {240 + i: texts[0].replace(" ", "  ") + " end" * i for i in range(3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert kept == {d for d, (_, c) in brute(texts, 80).items() if c == d}
    assert len(kept) == 150


def test_bands_follow_the_threshold():
    assert minhash.layout(85, 3e-6) == minhash.Layout(40, 8)
    for percent in (3, 20, 50, 70, 80, 85, 90, 99, 100):
        shape = minhash.layout(percent, 3e-6)
        assert (1 - (percent / 100) ** shape.rows) ** shape.bands <= 3e-6 and shape.minima % minhash.BATCH == 0
        assert percent < 4 or shape.minima <= minhash.HASHES


def test_posterior_bounds():
    least = minhash.least_matches(85, 1e-6)
    assert len(least) == minhash.HASHES // minhash.BATCH and all(a < b for a, b in zip(least, least[1:]))
    assert 100 * least[-1] / minhash.HASHES < 85


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 24))
    for i in range(40, 110):
        x[i] = x[i % 6] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])
    x[110:120] = x[3]
    x[120] = 5 * x[3]
    rows = [(i + 10, v.tolist(), None) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding.near_vectors(vectors(spark, rows).repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(x))])
    assert [got[i + 10].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i + 10].component_id - 10 for i in range(len(x))] == comp.tolist()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "n"), (2, [2.0, 0.0], "n"), (3, [0.0, 0.0], "n"), (4, None, "n"), (5, [1.0, None], "n"), (6, [float("nan"), 1.0], "n"),
            (7, [float("inf"), 1.0], "n"), (8, [], "n"), (None, [1.0, 0.0], "n"), (9, [1.0, 0.0, 0.0], "n"), (2, [2.0, 0.0], "n")]
    got = embedding.near_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id == 1] == [(2, 1, True)]
    assert [(r.n_links, r.component_id) for r in got if r.vec_id == 2] == [(2, 1)] * 2
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got if r.vec_id not in (1, 2))
    assert embedding.near_vectors(vectors(spark, rows).limit(0)).count() == 0
    assert embedding.near_vectors(vectors(spark, rows[2:8])).count() == 6


def test_code_estimate_is_unbiased_within_its_bound():
    turns = embedding.Rotations(64, 16, 20)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    y = x + rng.normal(size=(300, 64)) * 0.5
    wx, wy = turns.whole(x), turns.whole(y)
    (_, code, factor), (turned, _, _) = turns.coded(wx, 4), turns.coded(wy, 4)
    true = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    off = (code * turned).sum(1) / factor - true
    spread = np.sqrt((1 - factor**2) / (factor**2 * 255))
    assert abs(off.mean()) < 0.01 and (np.abs(off) < 6 * spread).all()


def test_stored_bytes_bound_the_inner_product():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 48))
    x[200:] = x[:200] + rng.normal(size=(200, 48)) * rng.choice([0.01, 0.3, 1.0], 200)[:, None]
    turns = embedding.Rotations(48, 16, 20)
    bits, level, figures = turns.compact(x, 4)
    turned, code, factor = turns.coded(turns.whole(x), 4)
    stored = embedding.Estimates(bits, level, figures, 6.0)
    assert level.nbytes == 400 * 256 and bits.shape == (400, turns.count * 8)
    assert (turns.keys(np.unpackbits(bits, axis=1).view(bool)) == turns.keys(turns.signs(turns.whole(x)))).all()
    assert np.allclose(stored.code, code) and np.allclose(figures[:, 0], factor)
    # What rounding to bytes changes stays within the stored slack, for every pair.
    assert (np.abs(code @ (turned - stored.turned).T) <= figures[:, 2] + 1e-6).all()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    p, q = np.arange(200), np.arange(200, 400)
    assert (stored.of_pairs(p, q) >= (u[p] * u[q]).sum(1)).all()
    assert np.allclose(stored.of_block(slice(0, 400))[p, q], stored.of_pairs(p, q), atol=1e-6)


def test_links_planted_around_the_threshold(spark):
    """3,000 pairs at cosines of 0.945 to 0.965 and one group of 300 near copies: every link is found and none too many."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.945, 0.965, 3000)[:, None]
    group = x[0] + rng.normal(size=(300, 64)) * 0.02
    every = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * side, group])
    rows = [(i, v.tolist(), None) for i, v in enumerate(every)]
    got = {r.vec_id: r.n_links for r in embedding.near_vectors(vectors(spark, rows).repartition(4)).collect()}
    u = every / np.linalg.norm(every, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    assert want.sum() > 90_000
    assert [got[i] for i in range(len(every))] == want.tolist()
