"""Quality scores: histogram gradient-boosted trees over statistics of a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm import boosting
from tallywatch.llm.common import kept, slices, some_rows, text_or_empty, trimmed
from tallywatch.llm.labelled import SAMPLE, remainder, training_texts
from tallywatch.llm.textstats import WordTable, letters_of, line_stats, per_text, repetition

#: Common function words in the languages at hand.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for was on are with as be this have from or by not der die das und ist von zu den mit auf für im ein eine "
    "le la les de des et un une est que dans pour sur el los las y del en por con se su una".split()
)
WIDTH = 12


def measure(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), WIDTH), np.float32)
    for i, word in enumerate(words):
        n = len(word)
        if word.isalpha():
            upper = 0 if word.islower() else sum(map(str.isupper, word))
            out[i] = (n, n, upper, 0, 0, 0, upper > 1 and upper == n, word.lower() in FUNCTION_WORDS, 0, 0, n > 20, n == 1)
            continue
        alpha = sum(map(str.isalpha, word))
        digits = sum(map(str.isdigit, word))
        stops = sum(map(word.count, ".,;:!?'\"()"))
        upper = sum(map(str.isupper, word))
        core = letters_of(word)
        out[i] = (
            n, alpha, upper, digits, stops, n - alpha - digits - stops, upper > 1 and upper == alpha, core.lower() in FUNCTION_WORDS,
            word[-1] in ".!?", alpha == 0, n > 20, word.count("!"),
        )
    return out


def features(table: WordTable, texts: list[str]) -> np.ndarray:
    """One row per text: lengths, shares of kinds of characters and words, repetition of words and lines."""
    codes, counts = table(texts)
    m = table.rows[codes]
    total = per_text(m, counts)
    words, chars = np.maximum(counts, 1)[:, None], np.maximum(total[:, :1], 1)
    spread = np.sqrt(np.maximum(per_text(m[:, :1].astype(np.float64) ** 2, counts) / words - (total[:, :1] / words) ** 2, 0))
    lines = np.array([line_stats(t) for t in texts]).reshape(-1, 3)
    return np.concatenate(
        [
            np.log1p(counts)[:, None], total[:, :1] / words, spread, total[:, 1:6] / chars, total[:, 6:12] / words, per_text(m[:, :1], counts, np.maximum),
            repetition(codes, counts), np.log1p(lines[:, :1]), lines[:, 1:], counts[:, None] / np.maximum(lines[:, :1], 1),
        ],
        axis=1,
    )


@dataclass
class QualityModel:
    forest: boosting.Forest

    def score(self, texts: list[str]) -> np.ndarray:
        table = kept(("quality",), lambda: WordTable(measure, WIDTH))
        return self.forest.probability(features(table, texts))


def train(docs: DataFrame, labels: DataFrame, divisor: int = 5, left_out: int = 0, rows: int = SAMPLE) -> QualityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out remainder; without any, the score is one half."""

    def statistics(batches):
        import pyarrow as pa

        table = WordTable(measure, WIDTH)
        for batch in some_rows(batches):
            x = features(table, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    got = training_texts(docs, labels, "quality", divisor, left_out, rows).mapInArrow(statistics, "label int, x array<double>").toArrow()
    if not got.num_rows:
        return QualityModel(boosting.fit(np.zeros((0, 1)), np.zeros(0)))
    x, y = np.array(got.column("x").to_pylist()), (got.column("label").to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))
    return QualityModel(boosting.fit(x[order], y[order]))


def score_documents(docs: DataFrame, model: QualityModel, divisor: int = 5, left_out: int = 0, threshold: float = 0.3) -> DataFrame:
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


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""

    place = docs.columns.index("text")

    def choose(batches):
        import pyarrow as pa

        for batch in some_rows(batches):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            good = np.concatenate([model.score(texts[a:b]) for a, b in slices(texts, 1 << 20)]) >= threshold if texts else np.zeros(0, bool)
            yield batch.filter(pa.array(good))
            trimmed()

    return docs.mapInArrow(choose, docs.schema)
