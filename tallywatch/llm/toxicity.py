"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm import boosting
from tallywatch.llm.common import kept, slices, some_rows, stored, text_or_empty
from tallywatch.llm.labelled import SAMPLE, remainder, training_texts
from tallywatch.llm.textstats import WordTable, letters_of, per_text

#: Words of abuse to begin with; more are learned from labelled texts.
INSULTS = frozenset("idiot moron stupid dumb loser pathetic trash scum worthless disgusting clown fool imbecile cretin jerk".split())
#: Second person in the languages at hand.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine euch tu te toi ton ta vous votre tú ti usted vos vosotros".split())
#: Signs and digits that stand for letters in disguised words.
DISGUISE = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "*": "", ".": "", "-": "", "_": ""})

_ODD_INSIDE = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")
_MARKS = re.compile(r"[^\w\s]")
WIDTH, NEAR = 13, 5
#: Shallow trees with heavy leaves: few labels are toxic, and the lexicon says most.
TREES = {"trees": 60, "depth": 3, "leaf_weight": 4.0}


def stems(word: str) -> list[str]:
    """What may be listed for a word: itself and its beginnings of four to six letters, marked as such."""
    return [word] + [word[:k] + "~" for k in (4, 5, 6) if len(word) > k]


def plain(word: str) -> str:
    return letters_of(word.lower())


def undisguised(word: str) -> str:
    return letters_of(word.lower().rstrip(".,;:?!").translate(DISGUISE))


@dataclass
class Features:
    """Dense features of texts under one lexicon of weighted stems."""

    lexicon: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        lexicon = self.lexicon
        return max((lexicon.get(s, 0.0) for s in stems(word)), default=0.0) if word else 0.0

    def measure(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), WIDTH), np.float32)
        for i, word in enumerate(words):
            core = plain(word)
            hit = self.weight(core)
            seed = core in INSULTS
            alpha = word.isalpha()
            marks = 0 if alpha else len(_MARKS.findall(word))
            hidden = 0
            if not alpha and not hit and not seed and core != word.lower():
                bare = undisguised(word)
                if bare != core:
                    hidden = bare in INSULTS or self.weight(bare) > 0
            upper = 0 if word.islower() else sum(map(str.isupper, word))
            out[i] = (
                len(word), upper, len(word) > 2 and upper >= 3 and word.isupper(), marks, 0 if alpha else word.count("!") + word.count("?"),
                hit, hit > 0, hidden, not alpha and _ODD_INSIDE.search(word) is not None, core in YOU, seed,
                0 if alpha else sum(map(str.isdigit, word)), _RUN.search(word) is not None,
            )
        return out

    def table(self) -> WordTable:
        return WordTable(self.measure, WIDTH)

    @staticmethod
    def rows(table: WordTable, texts: list[str]) -> np.ndarray:
        codes, counts = table(texts)
        m = table.rows[codes]
        total = per_text(m, counts)
        words = np.maximum(counts, 1)[:, None]
        chars = np.maximum(total[:, :1], 1)
        bad = (m[:, 6] > 0) | (m[:, 7] > 0) | (m[:, 10] > 0)
        you = m[:, 9] > 0
        # Distance of each word to the nearest second person in the same text, from both sides.
        at = np.arange(len(codes))
        starts = np.repeat(np.cumsum(counts) - counts, counts)
        before = np.maximum.accumulate(np.where(you, at, -1)) if len(at) else at
        gap = np.where(before >= starts, at - before, 99)
        after = np.minimum.accumulate(np.where(you, at, 1 << 60)[::-1])[::-1] if len(at) else at
        ends = np.repeat(np.cumsum(counts), counts)
        gap = np.minimum(gap, np.where(after < ends, after - at, 99))
        near = per_text(((gap <= NEAR) & bad)[:, None], counts)
        top = per_text(m[:, [5]], counts, np.maximum)
        listed, seeds = total[:, [6]], total[:, [10]]
        return np.concatenate(
            [
                np.log1p(counts)[:, None], total[:, [0]] / words, total[:, [1]] / chars, total[:, [2]] / words, total[:, [3]] / chars, total[:, [4]] / words,
                total[:, [5]] / words, total[:, [5]], listed / words, np.minimum(listed, 20), seeds / words, np.minimum(seeds, 20), total[:, [7]] / words,
                total[:, [7]], total[:, [8]] / words, total[:, [9]] / words, near, near / words, total[:, [11]] / chars, total[:, [12]] / words, top,
            ],
            axis=1,
        )


def lexicon_counts(texts: DataFrame) -> DataFrame:
    """(fold, stem, n0, n1): in how many texts of each label a stem occurs, put together from counts per partition."""

    def count(batches):
        import pyarrow as pa

        tally: dict[tuple, list[int]] = {}
        for batch in some_rows(batches):
            for fold, text, label in zip(*[c.to_pylist() for c in batch.columns]):
                found = {s for w in set(text.split()) for c in {plain(w), undisguised(w)} if 2 < len(c) < 40 for s in stems(c)}
                for s in found:
                    tally.setdefault((fold, s), [0, 0])[label > 0] += 1
                tally.setdefault((fold, ""), [0, 0])[label > 0] += 1
        keys = list(tally)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([tally[k][0] for k in keys], pa.int64()), pa.array([tally[k][1] for k in keys], pa.int64())],
            ["fold", "stem", "n0", "n1"],
        )

    part = texts.mapInArrow(count, "fold int, stem string, n0 long, n1 long")
    return part.groupBy("fold", "stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def weigh(counts: list, folds: tuple[int, ...], least: float = 3.0) -> dict[str, float]:
    """Stems that stand out in texts of label 1 by ``least`` standard deviations, with their log-odds (1 at least)."""
    n = {"": np.zeros(2)}
    for row in counts:
        if row.fold in folds:
            n.setdefault(row.stem, np.zeros(2))
            n[row.stem] += (row.n0, row.n1)
    clean, toxic = n.pop("")
    out = {}
    for stem, (a, b) in n.items():
        expected = (a + b) * toxic / max(clean + toxic, 1)
        if (b - expected) / np.sqrt(expected + 0.5) >= least:
            odds = np.log((b + 0.5) / (toxic + 1)) - np.log((a + 0.5) / (clean + 1))
            if odds >= 1:
                out[stem] = float(odds)
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    forest: boosting.Forest
    calibrate: boosting.Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        table = kept(("toxicity", self.forest.leaf.tobytes()), lambda: Features(self.lexicon).table())
        return np.clip(self.calibrate(self.forest.margin(Features.rows(table, texts))), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, divisor: int = 4, left_out: int = 2, rows: int = SAMPLE, stems_kept: int = 4000) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out remainder.

    Half of the folds weigh the lexicon under which the other half is measured and the other way
    round, so that no text is measured by words listed because of it. Scores are calibrated on
    margins of forests that had not seen the text. No labels give a score of one half everywhere.
    """
    # Bounded by ``rows``; written once, so that the documents are read once for all that follows.
    texts = stored(training_texts(docs, labels, "toxic", divisor, left_out, rows), "labelled")
    # A few thousand rows: stems seen in three toxic texts that are more common there, most telling first.
    counted = lexicon_counts(texts).groupBy("stem").agg(
        F.collect_list(F.struct("fold", "n0", "n1")).alias("each"), F.sum("n0").alias("s0"), F.sum("n1").alias("s1")
    )
    counted = stored(counted.where("stem = '' OR s1 >= 3 AND s1 > 0.2 * (s0 + s1)"), "stems")
    best = counted.where("stem <> ''").orderBy(((F.col("s1") - F.col("s0") * 0.2) / F.sqrt(F.col("s0") + F.col("s1"))).desc(), "stem").limit(stems_kept)
    whole = counted.where("stem = ''")
    counts = best.unionByName(whole).select("stem", F.explode("each").alias("e")).select("stem", "e.*").collect()
    halves = {f: Features(weigh(counts, tuple({0, 1, 2, 3} - {f, f ^ 1}))) if counts else Features() for f in range(4)}

    def measure(batches):
        import pyarrow as pa

        tables = {f: halves[f].table() for f in halves}
        for batch in some_rows(batches):
            fold, label = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            body = np.array(batch.column(1).to_pylist(), object)
            for f in np.unique(fold).tolist():
                x = Features.rows(tables[f], body[fold == f].tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), f), pa.int32()), pa.array(label[fold == f], pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["fold", "label", "x"]
                )

    got = texts.mapInArrow(measure, "fold int, label int, x array<double>").toArrow()
    if not got.num_rows:
        none = boosting.fit(np.zeros((0, 1)), np.zeros(0))
        return ToxicityModel({}, none, boosting.Isotonic(np.array([0.0]), np.array([0.5])))
    x, y = np.array(got.column("x").to_pylist()), (got.column("label").to_numpy() > 0).astype(float)
    fold = got.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    calibrate = boosting.isotonic(boosting.held_out(x, y, fold, **TREES), y)
    return ToxicityModel(weigh(counts, (0, 1, 2, 3)), boosting.fit(x, y, **TREES), calibrate)


def score_documents(docs: DataFrame, model: ToxicityModel, divisor: int = 4, left_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: whole texts, an empty text for a null one.

    Repeated rows are scored alike, each by itself; a null doc_id stays null. Scores depend on the text alone.
    """

    def score(batches):
        import pyarrow as pa

        for batch in some_rows(batches):
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 1 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(model.score(texts[a:b]), pa.float64())], ["doc_id", "held_out", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(divisor) == left_out).alias("held_out"), text_or_empty().alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
