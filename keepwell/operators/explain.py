"""Why a score is what it is: contributions, drivers, importances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from keepwell.operators.ranking import draw, hex_number
from keepwell.session import scratch_path

DRIVER_DIGITS = 9
RINGS = 1024
MAX_TREE_NODES = 5_000_000


def additive_contributions(df: DataFrame, parts: dict[str, Column], output: str = "contributions") -> DataFrame:
    """Adds an array of (feature, value): each part minus its mean over the table.

    For a sum of parts this is the exact attribution. The means are one row, read on
    the driver, and enter the plan as literals.
    """
    means = df.agg(*[F.avg(p).alias(f"m{i}") for i, p in enumerate(parts.values())]).first()
    cells = [F.struct(F.lit(n).alias("feature"),
                      F.round(p - F.lit(means[i] or 0.0), DRIVER_DIGITS).alias("value"))
             for i, (n, p) in enumerate(parts.items())]
    return df.withColumn(output, F.array(*cells))


def top_drivers(contributions: Column, k: int = 3) -> Column:
    """Names of the k largest by absolute value, ties by name."""
    ranked = F.array_sort(F.transform(contributions, lambda c: F.struct(
        (-F.abs(c["value"])).alias("size"), c["feature"].alias("feature"))))
    return F.transform(F.slice(ranked, 1, k), lambda c: c["feature"])


def global_importance(df: DataFrame, contributions: str = "contributions") -> DataFrame:
    """Mean absolute contribution per feature."""
    return (
        df.select(F.inline(contributions)).groupBy("feature")
        .agg(F.avg(F.abs("value")).alias("mean_abs"))
    )


def permutation_importance(df: DataFrame, key: str, label: str, columns: dict[str, str],
                           predict: Callable[[dict[str, Column]], Column], repeats: int = 5,
                           seed: str = "42", rings: int = RINGS) -> DataFrame:
    """(feature, importance_mean, importance_std): loss of accuracy when a column is permuted.

    ``columns`` names the input column of each feature, ``predict`` turns inputs
    into a 0/1 answer. Rows are dealt into a fixed number of random rings and ordered
    there once; in repeat i every row takes the values of the i-th next row of its
    ring: a permutation of the whole table that needs no global order and no join. All
    repeats and features are judged on the same pass.
    """
    inputs = sorted(set(columns.values()))
    word = draw(seed, F.col(key))
    dealt = df.select(key, F.col(label).alias("_y"), *inputs).withColumns({
        "_ring": F.pmod(hex_number(F.substring(word, 9, 8)), F.lit(rings)), "_word": hex_number(F.substring(word, 1, 15))})
    ring = Window.partitionBy("_ring").orderBy("_word", key)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swapped = F.struct(*inputs)
    place, size = F.row_number().over(ring), F.count(F.lit(1)).over(whole)
    heads = [F.nth_value(swapped, i).over(whole) for i in range(1, repeats + 1)]
    dealt = dealt.select("_y", *inputs, place.alias("_place"), size.alias("_size"), F.array(*heads).alias("_heads"),
                         *[F.lead(swapped, i).over(ring).alias(f"_lead{i}") for i in range(1, repeats + 1)])
    around = lambda i: F.get("_heads", ((F.col("_place") + (i - 1)) % F.col("_size")).cast("int"))
    others = [F.when(F.col("_place") + i <= F.col("_size"), F.col(f"_lead{i}")).otherwise(around(i)).alias(f"_other{i}")
              for i in range(1, repeats + 1)]
    own = {c: F.col(c) for c in inputs}

    def accuracy(answers: dict[str, Column]) -> Column:
        return F.avg((predict(answers) == F.col("_y")).cast("int"))

    judged = dealt.select("_y", *inputs, *others).agg(
        accuracy(own).alias("_base"),
        *[accuracy({**own, c: F.col(f"_other{i}")[c]}).alias(f"a{n}_{i}")
          for n, c in enumerate(columns.values()) for i in range(1, repeats + 1)])
    cells = [F.struct(F.lit(f).alias("feature"), (F.col("_base") - F.col(f"a{n}_{i}")).alias("loss"))
             for n, f in enumerate(columns) for i in range(1, repeats + 1)]
    return judged.select(F.inline(F.array(*cells))).groupBy("feature").agg(
        F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std"))


def top_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    return importances.orderBy(F.col("importance_mean").desc(), "feature").limit(n)


def leaf_shares(inside: np.ndarray, open_share: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of the features on the way to one leaf, per row.

    ``inside`` tells, per row and feature, whether the row passes all splits of that
    feature on the way; a feature out of the coalition passes the share ``open_share``
    of the rows. The weighted sum over all coalitions is an integral of a polynomial
    whose degree is below the number of features, so a Gauss rule gives it exactly.
    """
    width = len(open_share)
    if 1 << width < len(inside):  # fewer patterns than rows
        bits = np.arange(width)
        every = (np.arange(1 << width)[:, None] >> bits & 1).astype(bool)
        return leaf_shares(every, open_share, value)[inside @ (1 << bits)]
    at, weight = np.polynomial.legendre.leggauss((width + 1) // 2)
    at, weight = (at + 1) / 2, weight / 2
    factor = open_share[:, None] * (1 - at) + inside[:, :, None] * at
    others = factor.prod(axis=1, keepdims=True) / np.maximum(factor, np.finfo(float).tiny)
    return value * (inside - open_share) * (others @ weight)


class TreeTable:
    """The nodes of a tree ensemble as flat arrays; its size is that of the model."""

    ROWS = 4096

    def __init__(self, nodes: pd.DataFrame, weights: list[float]):
        nodes = nodes.sort_values(["tree", "id"], kind="stable")
        sizes = nodes.groupby("tree").size()
        self.roots = (sizes.cumsum() - sizes).to_numpy()
        start = np.repeat(self.roots, sizes.to_numpy())
        self.leaf = nodes["left"].to_numpy() < 0
        self.left = start + nodes["left"].to_numpy()
        self.right = start + nodes["right"].to_numpy()
        self.feature = nodes["feature"].to_numpy()
        self.threshold = nodes["threshold"].to_numpy()
        self.value = nodes["value"].to_numpy()
        self.cover = nodes["cover"].to_numpy().astype(float)
        self.weights = np.asarray(weights, float)
        #: What the ensemble answers if no feature is known.
        self.base = float(sum(weight * self.value[leaf] * np.prod(list(shares.values()))
                              for root, weight in zip(self.roots, self.weights) for leaf, _, shares in self.ways(root)))

    def ways(self, root: int) -> Iterator[tuple[int, list[tuple[int, bool]], dict[int, float]]]:
        """Per leaf of a tree: the splits before it, each with the side taken, and per feature the share of rows that pass them."""
        todo: list = [(root, [], {})]
        while todo:
            node, splits, shares = todo.pop()
            if self.leaf[node]:
                yield node, splits, shares
                continue
            split, cover = self.feature[node], max(self.cover[node], np.finfo(float).tiny)
            for child, left in ((self.left[node], True), (self.right[node], False)):
                passed = shares.get(split, 1.0) * self.cover[child] / cover
                todo.append((child, [*splits, (node, left)], {**shares, split: passed}))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Per row and feature the exact Shapley value, where an unknown feature's splits are averaged by how many rows they had."""
        out = np.zeros(x.shape)
        for at in range(0, len(x), self.ROWS):
            rows, part = x[at:at + self.ROWS], out[at:at + self.ROWS]
            for root, weight in zip(self.roots, self.weights):
                for leaf, splits, shares in self.ways(root):
                    if not splits:
                        continue
                    features = list(shares)
                    inside = np.ones((len(rows), len(features)), dtype=bool)
                    for node, left in splits:
                        split = self.feature[node]
                        inside[:, features.index(split)] &= (rows[:, split] <= self.threshold[node]) == left
                    part[:, features] += leaf_shares(inside, np.array(list(shares.values())), weight * self.value[leaf])
        return out


def tree_table(spark: SparkSession, model) -> TreeTable:
    """The nodes of a fitted boosted or forest classifier, read from its saved form.

    Boosted trees are explained on the raw margin, forests on the probability.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    boosted = isinstance(model, GBTClassificationModel)
    stats = F.col("nodeData.impurityStats")
    rows = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    share = F.element_at(stats, 2) / rows
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.coalesce(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        (F.col("nodeData.prediction") if boosted else share).alias("value"),
        (F.element_at(stats, 1) if boosted else rows).alias("cover"),
    )
    table = nodes.limit(MAX_TREE_NODES + 1).toPandas()
    if len(table) > MAX_TREE_NODES:
        raise ValueError("the model has too many nodes to ship to every task")
    weights = list(model.treeWeights) if boosted else [1.0 / model.getNumTrees] * model.getNumTrees
    return TreeTable(table, weights)


def tree_contributions(df: DataFrame, model, names: list[str], features: str = "features",
                       output: str = "contributions") -> tuple[DataFrame, float]:
    """Adds an array of (feature, Shapley value) per row; base + sum of values is the model's answer.

    The node table is broadcast (its size is capped) and rows are explained where
    they are, batch by batch.
    """
    spark = df.sparkSession
    table = tree_table(spark, model)
    shipped = spark.sparkContext.broadcast(table)
    schema = StructType([*df.schema.fields, StructField("_values", ArrayType(DoubleType()))])

    def explain(batches):
        trees = shipped.value
        for batch in batches:
            if len(batch):
                x = np.stack(batch[features].to_numpy()).astype(float)
                yield batch.assign(_values=list(trees.contributions(x)))

    named = F.transform("_values", lambda v, i: F.struct(
        F.element_at(F.array(*[F.lit(n) for n in names]), i + 1).alias("feature"), v.alias("value")))
    return df.mapInPandas(explain, schema).withColumn(output, named).drop("_values"), table.base
