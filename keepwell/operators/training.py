"""Training, tuning and scoring on Spark ML, with the exact metrics of this package."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from keepwell.functions import values as V
from keepwell.operators import metrics
from keepwell.operators.outcomes import class_weights
from keepwell.operators.sampling import balanced, stratified_folds
from keepwell.session import settle


@dataclass(frozen=True)
class BoostedParams:
    trees: int = 150
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 1.0
    positive_weight: float = 1.0


# fixed values: parameters of the automatic retraining, the search, the forest
RETRAIN_PARAMS = BoostedParams(trees=250, depth=3, rate=0.08, rows=0.95, columns=0.90, positive_weight=1.5)
TREES, DEPTH, RATE = (100, 300), (3, 8), (0.01, 0.2)
ROWS, COLUMNS, POSITIVE_WEIGHT = (0.6, 1.0), (0.5, 1.0), (1.0, 5.0)
SEARCH_TRIALS, SEARCH_FOLDS, FOREST_TREES = 30, 3, 300
SEED = 42


def drawn_params(n: int = SEARCH_TRIALS, seed: int = SEED) -> list[BoostedParams]:
    """Repeatable random candidates; the learning rate is drawn on a log scale."""
    pick = random.Random(seed)
    low, high = RATE
    return [BoostedParams(
        trees=pick.randint(*TREES), depth=pick.randint(*DEPTH),
        rate=low * (high / low) ** pick.random(), rows=pick.uniform(*ROWS),
        columns=pick.uniform(*COLUMNS), positive_weight=pick.uniform(*POSITIVE_WEIGHT),
    ) for _ in range(n)]


def _prepared(df: DataFrame, label: str, features: str) -> DataFrame:
    return df.withColumns({"_x": array_to_vector(F.col(features)), "_y": F.col(label).cast("double")})


def fit_boosted(train: DataFrame, params: BoostedParams = BoostedParams(), label: str = "Churn",
                features: str = "features", weight: str | None = None):
    row = F.col(weight) if weight else F.lit(1.0)
    rows = _prepared(train, label, features).withColumn(
        "_w", row * F.when(F.col("_y") == 1, params.positive_weight).otherwise(1.0))
    return GBTClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=params.trees, maxDepth=params.depth,
        stepSize=params.rate, subsamplingRate=params.rows, seed=SEED,
        featureSubsetStrategy="all" if params.columns >= 1 else str(params.columns),
    ).fit(rows)


def fit_forest(train: DataFrame, trees: int = FOREST_TREES, depth: int = 10, label: str = "Churn",
               features: str = "features"):
    """Classes weigh n / (classes * n_class); the weights are one row per class."""
    weights = class_weights(train, label).select(label, F.col("weight").alias("_w"))
    rows = _prepared(train.join(F.broadcast(weights), label), label, features)
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees,
                                  maxDepth=depth, seed=SEED).fit(rows)


def scored(model, df: DataFrame, features: str = "features", output: str = "churn_score") -> DataFrame:
    """Adds the probability of leaving; a narrow stage."""
    ready = df.withColumn("_x", array_to_vector(F.col(features)))
    return model.transform(ready).withColumn(output, vector_to_array("probability")[1]).drop(
        "_x", "rawPrediction", "probability", "prediction")


def tune(train: DataFrame, key: str, label: str = "Churn", features: str = "features",
         candidates: list[BoostedParams] | None = None, folds: int = SEARCH_FOLDS,
         parallelism: int = 4) -> tuple[BoostedParams, list[tuple[BoostedParams, float]]]:
    """The candidate with the best mean PR-AUC over stratified folds.

    Only the training part of a fold is oversampled, once for all candidates.
    """
    candidates = candidates or drawn_params()
    dealt = settle(stratified_folds(train.select(key, label, features), label, key, folds))
    parts = [
        (settle(balanced(dealt.where(F.col("fold") != i), label, key, features)), dealt.where(F.col("fold") == i))
        for i in range(folds)
    ]

    def quality(params: BoostedParams) -> float:
        areas = [
            metrics.pr_auc(scored(fit_boosted(fit, params, label, features), check, features),
                           label, "churn_score").first()["pr_auc"] or 0.0
            for fit, check in parts
        ]
        return sum(areas) / len(areas)

    with ThreadPoolExecutor(parallelism) as pool:
        results = list(zip(candidates, pool.map(quality, candidates)))
    return max(results, key=lambda r: r[1])[0], results


def evaluate(model, name: str, test: DataFrame, label: str = "Churn", features: str = "features",
             threshold: float = V.DECISION_THRESHOLD) -> DataFrame:
    """One row (model, roc_auc, pr_auc, recall, cost) for the comparison table."""
    rows = scored(model, test, features).select(F.lit(name).alias("model"), label, "churn_score")
    return metrics.model_comparison(rows, "model", label, "churn_score", threshold)
