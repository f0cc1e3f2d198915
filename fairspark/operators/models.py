"""Classifiers by name, fitted once and used as often as needed.

pyspark.ml has no kernel support vector machine: rbf_svc is that of ``svm``, exact at any size; fourier_svc is a linear one on random
Fourier features of the radial kernel, and nothing becomes it unasked.  It has no second-order boosting: xgb
is that of ``boosting``, with Spark's first-order gbt beside it.  Trees and forests are
exact ones of any depth (``trees``); with a depth given they are Spark's, to 30 at most, by quantile bins of a feature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.operators import boosting, svm, trees
from fairspark.operators.distribution import three_sets
from fairspark.operators.encode import common_columns
from fairspark.operators.fairness import fairness
from fairspark.operators.performance import performance
from fairspark.plans.storage import checkpointed

_COLUMNS = {"labelCol": "target", "featuresCol": "_features", "predictionCol": "prediction"}


@dataclass(frozen=True)
class Settings:
    """depth (None: any, exactly) and bins of trees, trees of a forest, depth and rounds of boosting, random features of fourier_svc, penalty of both."""

    depth: int | None = None
    bins: int = 256
    trees: int = 100
    boosted_depth: int = 6
    rounds: int = 50
    waves: int = 256
    c: float = 1.0


DEFAULTS = Settings()


def classifier(name: str, seed: int = 42, rows: int = 1000, settings: Settings = DEFAULTS):
    """A new classifier; rows: of the training data, for the strength of penalties."""
    s = settings
    made = {
        "logistic_regression": lambda: LogisticRegression(regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, **_COLUMNS),
        "linear_svc": lambda: LinearSVC(**_COLUMNS),
        "gaussian_nb": lambda: NaiveBayes(modelType="gaussian", **_COLUMNS),
        "decision_tree": lambda: DecisionTreeClassifier(maxDepth=s.depth or 30, maxBins=s.bins, seed=seed, **_COLUMNS),
        "random_forest": lambda: RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth or 30, maxBins=s.bins, seed=seed, **_COLUMNS),
        "gbt": lambda: GBTClassifier(maxIter=s.rounds, maxDepth=s.boosted_depth, maxBins=s.bins, seed=seed, **_COLUMNS),
    }
    if name not in made:
        raise ValueError(f"no such classifier: {name}")
    return made[name]()


SURROGATES = ("logistic_regression", "rbf_svc", "gaussian_nb", "decision_tree", "random_forest")
TARGET = "xgb"


class Fitted(NamedTuple):
    """A fitted pipeline and the expression that gives its ``_features``."""

    model: PipelineModel
    features: Callable[[DataFrame], DataFrame]


def fit(train: DataFrame, name: str, features: Sequence[str], seed: int = 42, settings: Settings = DEFAULTS) -> Fitted:
    rows = train.count() if name == "logistic_regression" else 1000
    add = VectorAssembler(inputCols=list(features), outputCol="_features").transform
    return Fitted(Pipeline(stages=[classifier(name, seed, rows, settings)]).fit(add(train.withColumn("target", F.col("target").cast("double")))), add)


def predict(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """The rows with ``prediction`` (0/1)."""
    keep = rows.columns
    return fitted.model.transform(fitted.features(rows)).select(*(F.col(f"`{c}`") for c in keep), F.col("prediction").cast("int").alias("prediction"))


def fit_predict(train: DataFrame, validation: DataFrame, name: str, features: Sequence[str], seed: int = 42, settings: Settings = DEFAULTS) -> DataFrame:
    """Fits to the features that both have, chosen by name."""
    both = [c for c in common_columns(train, validation) if c in set(features)]
    exact = {"decision_tree": trees.Growth(1, None, False, seed=seed), "random_forest": trees.Growth(settings.trees, seed=seed)}
    if name in exact and settings.depth is None:
        return trees.fit_predict(train, validation, both, exact[name])
    if name == "xgb":
        return boosting.predict(boosting.fit(train, both, boosting.Settings(rounds=settings.rounds, depth=settings.boosted_depth, bins=settings.bins)), validation, both)
    if name == "rbf_svc":
        try:
            machine = svm.exact(train, both, settings.c)
        except svm.TooMany:
            machine = svm.fit(train, both, settings.c)  # the same problem in its dual
        return svm.predict(machine, validation, both)
    if name == "fourier_svc":
        return svm.predict(svm.approximate(train, both, settings.c, settings.waves, seed), validation, both)
    return predict(fit(train, name, both, seed, settings), validation)


def assess(train: DataFrame, validation: DataFrame, name: str, features: Sequence[str], protected: str, seed: int = 42, key: str = "row_id", settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(metrics, distributions) of one classifier: a row a group, and shares in the three sets.

    Predictions are written to the shared folder, as four aggregations read them.
    """
    scored = fit_predict(train, validation, name, features, seed, settings).withColumn("y", F.col("target").cast("int")).withColumn("p", F.col("prediction"))
    scored = checkpointed(scored)
    looked_at = [c for c in features if c in scored.columns]
    metrics = fairness(scored, protected, key=key, features=looked_at).join(F.broadcast(performance(scored))).withColumn("classification_algorithm", F.lit(name))
    shares = three_sets(train.withColumn("y", F.col("target").cast("int")), scored, protected).withColumn("classification_algorithm", F.lit(name))
    return metrics, shares
