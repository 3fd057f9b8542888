"""One way to score rows, whatever the model is.

A scorer adds a score column computed from named inputs. Column scorers stay inside the
query plan; MLlib models use their own transform; a Python function gets Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ColumnScorer:
    """A score that is an expression over its input columns."""

    def __init__(self, expression: Callable[[dict[str, Column]], Column]):
        self.expression = expression

    def add(self, df: DataFrame, inputs: dict[str, Column], out: str = "score") -> DataFrame:
        return df.withColumn(out, self.expression(inputs))


def linear_scorer(weights: dict[str, float], bias: float = 0.0) -> ColumnScorer:
    return ColumnScorer(lambda x: sum((x[n] * w for n, w in weights.items()), F.lit(bias)))


def logistic_scorer(weights: dict[str, float], bias: float = 0.0) -> ColumnScorer:
    line = linear_scorer(weights, bias).expression
    return ColumnScorer(lambda x: 1.0 / (1.0 + F.exp(-line(x))))


class ModelScorer:
    """A fitted MLlib model: probability of class 1 where it has one, else its prediction."""

    def __init__(self, model, features: Sequence[str]):
        self.model = model
        self.features = list(features)

    def add(self, df: DataFrame, inputs: dict[str, Column], out: str = "score") -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        column = self.model.getOrDefault("featuresCol")
        rows = df.withColumn(column, array_to_vector(F.array(*[inputs[f].cast("double") for f in self.features])))
        scored = self.model.transform(rows)
        value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        return scored.select(*df.columns, value.alias(out))


class BatchScorer:
    """A Python function from a pandas frame of the features to scores, fed Arrow batches."""

    def __init__(self, function: Callable, features: Sequence[str]):
        self.function = function
        self.features = list(features)

    def add(self, df: DataFrame, inputs: dict[str, Column], out: str = "score") -> DataFrame:
        from pyspark.sql.types import DoubleType

        function, features = self.function, self.features

        @F.pandas_udf(DoubleType())
        def run(*columns):
            import pandas as pd

            return pd.Series(function(pd.concat(columns, axis=1, keys=features)), dtype="float64")

        return df.withColumn(out, run(*[inputs[f].cast("double") for f in features]))


Scorer = ColumnScorer | ModelScorer | BatchScorer


def own_inputs(features: Sequence[str]) -> dict[str, Column]:
    return {f: F.col(f) for f in features}


def score(df: DataFrame, scorer: Scorer, features: Sequence[str], out: str = "score") -> DataFrame:
    """Batch prediction."""
    return scorer.add(df, own_inputs(features), out)


def evaluate(df: DataFrame, scorer: Scorer, features: Sequence[str], label: str, cutoff: float | None = 0.5) -> DataFrame:
    """Classification metrics at ``cutoff``, or regression metrics when it is None."""
    from tallywatch.operators.performance import classification_metrics, regression_metrics

    rows = score(df, scorer, features)
    if cutoff is None:
        return regression_metrics(rows, label, "score")
    return classification_metrics(rows.withColumn("_p", (F.col("score") >= cutoff).cast("int")), label, "_p")
