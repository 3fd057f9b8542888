import random
import string

import duckdb
import numpy as np
import pandas as pd
from oracle_compare import compare

from tallywatch.llm import boosting, labelled, quality, secret_scan, toxicity


def test_secrets_against_sql(spark):
    r = random.Random(3)
    symbols = string.ascii_letters + string.digits + "+/_=-"
    rows = [(900, None), (901, ""), (902, "x" * 5000 + "token=abcdef " * 300), (903, "token=token:abcdefgh"), (904, "state-of-the-art-" * 4)]
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 10)):
            parts.append(r.choice([
                "".join(r.choice(symbols) for _ in range(r.choice([5, 23, 24, 60, 300]))),
                "".join(r.choice("0123456789abcdefABCDEF"[: r.choice([3, 16, 22])]) for _ in range(r.choice([20, 24, 64]))),
                r.choice(["password", "Api_Key", "TOKEN", "passwd"]) + r.choice(["=", ": ", '" : "', "  ='"]) + r.choice(["abc", "hunter22", "a.b=c_d-e"]),
                "AKIA" + "".join(r.choice("AKI12Z") for _ in range(r.choice([3, 15, 16, 40]))),
                r.choice(["äöü", "the 𝒳 end", "\n", "a" * 31, "ſecret=abcdefg", "😀😀", "550e8400-e29b-41d4-a716-446655440000"]),
            ]))
        rows.append((i, r.choice([" ", ""]).join(parts)))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert compare(secret_scan.scan_secrets(docs), con, secret_scan.oracle_sql()) == ""


def test_secrets_of_odd_rows(spark, odd_docs, no_docs):
    assert secret_scan.scan_secrets(odd_docs).count() == odd_docs.count()
    assert secret_scan.scan_secrets(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "my token = 'abcdef0123456789abcdef0123456789' and more", "z"), (2, None, "z"), (3, "plain", "z")], "doc_id long, text string, secret_base string")
    rows = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert rows[1].text == "my <secret>' and more" and rows[2].text is None and rows[3].text == "plain"
    assert secret_scan.redact(docs).columns == docs.columns and {r.secret_base for r in rows.values()} == {"z"}


def test_random_strings_of_every_class(spark):
    r = random.Random(7)
    up, low, digits = secret_scan.UPPER, secret_scan.UPPER.lower(), secret_scan.DIGITS
    kinds = {"base64": up + low + digits + "+/", "base36": low + digits, "base32": up + "234567", "hex": digits + "abcdef", "letters": up + low}
    rows, planted = [], {}
    for k, (kind, letters) in enumerate(kinds.items()):
        for i in range(200):
            token = "".join(r.choice(letters) for _ in range(40))
            before = r.choice(["see ", "/example/", "example_key=", "x-"]) if kind != "hex" else "see "
            doc_id = 1000 * k + i
            rows.append((doc_id, f"{before}{token} and on"))
            planted[doc_id] = (kind, token)
    got = {d.doc_id: d for d in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in kinds:
        hits = [bool(got[d].secret_all) for d, (k, _) in planted.items() if k == kind]
        assert sum(hits) / len(hits) >= (0.9 if kind == "letters" else 0.97), (kind, sum(hits) / len(hits))
    clean = [
        "a path of /usr/share/internationalization/examples-of-words/andManyJoinedWords/InCamelCase-here", "=" * 80, "12345678-1234567890-1234567890",
        "see 123e4567-e89b-12d3-a456-426614174000.", "key AbCd1EXAMPLEfGh2iJk3LmN4oPqR", "_".join(["snake", "case"] * 20), "REALLY_LONG_CONSTANT_NAMES_OF_SETTINGS",
    ]
    docs = spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")
    assert [r.doc_id for r in secret_scan.secret_spans(docs).collect() if r.secret_all] == []


def test_text_of_many_matches(spark):
    r = random.Random(8)
    tokens = ["".join(r.choice("0123456789abcdef") for _ in range(24)) for _ in range(20_000)]
    docs = spark.createDataFrame([(1, "é ".join(tokens))], "doc_id long, text string")
    (row,) = docs.select(secret_scan.located(docs.text, secret_scan.HEX).alias("m")).collect()
    assert [(m.start, m.end, m.value) for m in row.m] == [(26 * i, 26 * i + 24, t) for i, t in enumerate(tokens)]


def auc(score, label):
    order = pd.Series(score).rank().to_numpy()
    ones = label > 0
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_boosting_learns_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000])
    assert auc(forest.margin(x[2000:]), y[2000:]) > 0.97
    curve = boosting.isotonic(forest.margin(x[:2000]), y[:2000])
    steps = curve(np.linspace(-5, 5, 50))
    assert (np.diff(steps) >= 0).all() and 0 <= steps.min() and steps.max() <= 1
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert len(set(boosting.fit(np.zeros((9, 2)), np.ones(9)).margin(np.zeros((2, 2))))) == 1


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, 500).astype(float)
    forest = boosting.fit(x, y, trees=5, depth=3)

    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])


def corpus(spark):
    r = random.Random(8)
    good = ["river", "stone", "the", "of", "morning", "walked", "under", "and", "light", "hill", "slowly", "house"]
    rows, labels = [], []
    for i in range(500):
        words = [r.choice(good) for _ in range(r.randint(5, 80))]
        toxic = i % 5 == 0
        bad = i % 7 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "vequando", "vequeso", "st*pid", "l0ser"]))
            words.insert(0, "you")
        rows.append((i, ("!! ".join(w.upper() for w in words) if bad else " ".join(words)).replace(" hill", ". Hill"), "z"))
        labels.append((i, int(not bad), int(toxic), "z"))
    rows += [(1000, None, "z"), (1001, "", "z"), (None, "idiot", "z"), (3, rows[3][1], "z"), (1002, "word " * 30000, "z")]
    labels += [(7777, 1, 1, "z"), (None, 1, 0, "z"), (4, None, None, "z"), (5, 1, 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_classifiers(spark):
    docs, labels = corpus(spark)
    known = {r.doc_id: r for r in labels.collect()}
    for module, name, least in ((toxicity, "toxic", 0.9), (quality, "quality", 0.95)):
        scored = module.score_documents(docs, module.train(docs, labels)).collect()
        assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
        held = [r for r in scored if r.held_out and r.doc_id is not None and r.doc_id < 500]
        assert auc(np.array([r.score for r in held]), np.array([known[r.doc_id][name] or 0 for r in held])) > least
        assert len({r.score for r in scored if r.doc_id == 3}) == 1


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark)
    from pyspark.sql import functions as F

    from tallywatch.llm.labelled import remainder

    turned = labels.withColumn("quality", F.when(remainder(5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.score_documents(docs, quality.train(docs, x)).orderBy("doc_id", "score").collect() for x in (labels, turned))
    assert one == two


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    none = labels.limit(0)
    for module in (toxicity, quality):
        assert {r.score for r in module.score_documents(docs, module.train(docs, none)).collect()} == {0.5}
        assert module.score_documents(docs.limit(0), module.train(docs, none)).count() == 0
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_training_rows_are_bounded_where_doc_ids_repeat(spark):
    labels = spark.range(60).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    once = spark.range(60).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    copies = spark.range(500).selectExpr("1L AS doc_id", "'text 1' AS text")
    plain = labelled.training_texts(once, labels, "quality", 1000, 999).collect()
    assert len(plain) == 60
    assert sorted(labelled.training_texts(once.union(copies), labels, "quality", 1000, 999).collect()) == sorted(plain)
    many = spark.range(500).selectExpr("1L AS doc_id", "concat('other ', id) AS text")
    got = labelled.training_texts(once.union(many), labels, "quality", 1000, 999, rows=100).collect()
    assert len(got) == 100 and len({r.text for r in got}) == 100
