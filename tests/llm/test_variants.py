"""Spelling variants against all pairs of words in plain Python."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallywatch.llm import variants
from tallywatch.llm.variants import near_words, spelling_forms, word_counts

ROW = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(docs):
    found = {}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] = found.get(run, 0) + 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(words):
    form, out = {}, {}
    for w, n in words.items():
        about = sorted((-words[v], v) for v in words if near(w, v))
        form[w] = about[0][1] if about and -about[0][0] >= 5 * n else None
        out[w] = len(about)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return rows


def made(rng, size):
    """Words that differ by an edit here and there, many of one beginning, and the numbers of their uses."""
    words = {"a" * 6: 400, "a" * 7: 2000, "a" * 8: 6, "ÿ" * 300: 5, "ÿ" * 299: 30, "ÿ" * 301: 5}
    while len(words) < size:
        base = rng.choice(["", "inter", "international"]) + "".join(rng.choice("abéÿz") for _ in range(rng.randint(6, 9)))
        words[base] = rng.choice([5, 7, 40, 300])
        for _ in range(3):
            i, c = rng.randrange(len(base)), rng.choice("abéÿz")
            words.setdefault(rng.choice([base[:i] + c + base[i:], base[:i] + c + base[i + 1 :], base[:i] + base[i + 1 :]]), rng.choice([5, 60, 1500]))
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize(("full", "step"), [(2, 64), (1 << 12, 1 << 15), (40, 1)])
def test_near_words_are_all_found(spark, monkeypatch, full, step):
    monkeypatch.setattr(variants, "FULL", full)
    monkeypatch.setattr(variants, "STEP", step)
    words = made(random.Random(full), 700)
    got = {tuple(r) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = set()
    for w in words:
        about = sorted((-words[v], v) for v in words if near(w, v))
        if about:
            want.add((w, len(about), -about[0][0], about[0][1]))
    assert got == want


def test_forms_and_roots(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(w + rng.choice([" ", "-", "\n", "_"]) for w in rng.choices(["Colour", "colour", "color", "colors", "COLORS", "Éclair", "éclair", "eclair", "harbour", "harbor", "harbors"], k=900))) for i in range(12)]
    docs += [(None, "colour " * 8000), (None, None), (50, ""), (50, "naïveté, naivete " * 40), (50, "naïveté, naivete " * 40), (51, "x" * 100_000 + "ab1"), (52, "colourr " * 20 + "colourrr " * 5)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("h", F.lit("h"))
    assert {tuple(r) for r in word_counts(table).collect()} == set(counts(docs).items())
    got = spelling_forms(table)
    assert {tuple(r[c] for c in ROW) for r in got.collect()} == brute(counts(docs))
    assert spelling_forms(table.limit(0)).count() == 0


def test_a_third_of_all_words_share_a_half(spark, monkeypatch):
    monkeypatch.setattr(variants, "FULL", 64)
    rng = random.Random(9)
    words = {"abcdef" + "".join(rng.choice("xyzw") for _ in range(6)): rng.choice([5, 50]) for _ in range(1500)}
    got = {r.word: r.n_near for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = {w: sum(near(w, v) for v in words) for w in words}
    assert got == {w: k for w, k in want.items() if k}
