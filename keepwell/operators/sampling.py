"""Repeatable splits, folds and minority oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepwell.operators.neighbours import nearest
from keepwell.operators.ranking import draw, hash_segments, share
from keepwell.session import settle


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2,
                     seed: str = "42") -> DataFrame:
    """Adds ``split``: per class the first ceil(share * n) rows in drawn order are test; rows without a label are a class."""
    placed = hash_segments(df, [label], key, seed, lambda n: [F.ceil(F.lit(test_share) * n)], "_segment")
    return placed.withColumn("split", F.when(F.col("_segment") == 0, "test").otherwise("train")).drop("_segment")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 3, seed: str = "42") -> DataFrame:
    """Adds ``fold`` 0..folds-1: per class consecutive parts of the drawn order, even up to one row."""
    return hash_segments(df, [label], key, f"{seed}:fold",
                         lambda n: [F.ceil(n * i / F.lit(folds)) for i in range(1, folds)], "fold")


def oversample(df: DataFrame, label: str, key: str, features: str = "features", k: int = 5,
               seed: str = "42") -> DataFrame:
    """New minority rows up to class balance: (synthetic_id, base_id, neighbour_id, label, features).

    Each new row lies between a minority row and one of its k nearest minority
    rows. Bases are dealt out evenly in drawn order, so every row is used equally
    often up to one. Only the class counts reach the driver.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect() if r[label] is not None}
    minority = min(counts, key=lambda c: (counts[c], str(c)))
    size, missing = counts[minority], max(counts.values()) - counts[minority]
    rare = settle(df.where(F.col(label) == minority).select(
        F.col(key).alias("id"), F.col(features).cast("array<double>").alias("vector")))
    dealt = hash_segments(rare, [], "id", f"{seed}:base", lambda n: [F.lit(missing % size)], "_segment")
    copies = F.lit(missing // size) + (F.col("_segment") == 0).cast("int")
    bases = dealt.withColumn("copies", copies).where("copies > 0").drop("_segment")
    found = nearest(bases, rare, k + 1).where("query_id != neighbour_id")  # k + 1 rows per query at most
    around = found.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("position", "neighbour_id"))), 1, k).alias("ring"))
    number = F.col("copy").cast("string")
    pick = F.floor(share(draw(f"{seed}:pick", F.col("id"), number)) * F.size("ring")).cast("int") + 1
    drawn = (
        bases.join(around, bases["id"] == around["query_id"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumn("neighbour_id", F.element_at("ring", pick)["neighbour_id"])
        .withColumn("step", share(draw(f"{seed}:step", F.col("id"), number)))
        .select("id", "copy", "neighbour_id", "step", "vector")
    )
    other = rare.select(F.col("id").alias("neighbour_id"), F.col("vector").alias("other"))
    step = F.col("step")
    return drawn.join(other, "neighbour_id").select(
        F.concat_ws(":", F.lit("new"), F.col("id").cast("string"), number).alias("synthetic_id"),
        F.col("id").alias("base_id"), "neighbour_id", F.lit(minority).alias(label),
        F.zip_with("vector", "other", lambda a, b: a + step * (b - a)).alias(features))


def balanced(df: DataFrame, label: str, key: str, features: str = "features", k: int = 5,
             seed: str = "42", weight: str | None = None) -> DataFrame:
    """The table with its oversampled rows; those weigh 1."""
    new = oversample(df, label, key, features, k, seed).select(
        F.col("synthetic_id").alias(key), label, features)
    own = df.select(F.col(key).cast("string").alias(key), label, features, *([weight] if weight else []))
    if weight:
        new = new.withColumn(weight, F.lit(1.0))
    return own.unionByName(new)
