"""The log of retention attempts: totals, latest results, training weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# fixed values: training weight of a row by its customer's latest outcome
RETAINED_WEIGHT, LOST_WEIGHT, PLAIN_WEIGHT = 2.0, 0.5, 1.0


def latest_outcome(outcomes: DataFrame, key: str = "customer_id",
                   order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """The last known outcome per customer; unknown outcomes do not count."""
    return outcomes.where("outcome IS NOT NULL").groupBy(key).agg(
        F.max_by("outcome", F.struct(*order)).alias("outcome"))


def sample_weights(rows: DataFrame, outcomes: DataFrame, key: str, outcome_key: str = "customer_id",
                   order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    last = latest_outcome(outcomes, outcome_key, order).select(
        F.col(outcome_key).cast("string").alias("_key"), "outcome")
    weight = (
        F.when(F.col("outcome") == 1, RETAINED_WEIGHT)
        .when(F.col("outcome").isNotNull(), LOST_WEIGHT)
        .otherwise(PLAIN_WEIGHT)
    )
    return (
        rows.join(last, F.col(key).cast("string") == F.col("_key"), "left")
        .withColumn("weight", weight).drop("_key", "outcome")
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * n_class); the table has one row per class."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.select(
        label, "n",
        (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def with_logged_outcome(customers: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Only customers that appear in the log; the key set is reduced first."""
    keys = outcomes.select(F.col("customer_id").alias(key)).distinct()
    return customers.join(keys, key, "left_semi")


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("n_outcomes"),
        F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("n_retained"),
    ).withColumn("success_rate", F.coalesce(
        F.try_divide(F.col("n_retained").cast("double"), F.col("n_outcomes")) * 100.0, F.lit(0.0)))


def campaign_results(outcomes: DataFrame) -> DataFrame:
    """Attempts per intervention and result; the two results are known columns."""
    return outcomes.groupBy("intervention_type").agg(
        F.count_if(F.col("outcome") == 0).alias("churned"),
        F.count_if(F.col("outcome") == 1).alias("retained"))
