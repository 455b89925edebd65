"""Risk tables, key figures and the canned questions over scored customers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from keepwell.functions import features as X, render, values as V
from keepwell.operators.ranking import running_totals
from keepwell.session import settle


def risk_filter(scored: DataFrame, min_score: float | None = None, contract: str = "All",
                segment: str = "All") -> DataFrame:
    conditions = [F.lit(True)]
    if min_score is not None:
        conditions.append(F.col("churn_score") >= F.lit(min_score))
    if contract != "All":
        conditions.append(F.col("Contract") == contract)
    if segment != "All":
        conditions.append(X.report_segment(F.col("tenure")) == segment)
    return scored.where(reduce(lambda a, b: a & b, conditions))


def with_contract_name(df: DataFrame) -> DataFrame:
    return df.withColumn("Contract", X.decoded(F.col("contract_type_encoded"), V.CONTRACT_CODES, "Unknown"))


def risk_table(scored: DataFrame, key: str = "customerID") -> DataFrame:
    """Highest score first, formatted after sorting; ties by key."""
    drivers = [F.array_join("top_drivers", ", ").alias("top_drivers")] if "top_drivers" in scored.columns else []
    return scored.orderBy(F.col("churn_score").desc(), key).select(
        key, "Contract", "tenure", render.dollars(F.col("MonthlyCharges")).alias("MonthlyCharges"),
        render.percent(F.col("churn_score")).alias("churn_score"), *drivers)


def risk_figures(scored: DataFrame, high: float = V.HIGH_SCORE) -> DataFrame:
    return scored.agg(F.count_if(F.col("churn_score") > F.lit(high)).alias("n_high"),
                      F.avg("churn_score").alias("avg_score"))


def price_sensitive(scored: DataFrame, threshold: float = V.DECISION_THRESHOLD,
                    charge: float = V.PRICE_SENSITIVE_CHARGE) -> DataFrame:
    return scored.where((F.col("churn_score") >= F.lit(threshold)) & (F.col("MonthlyCharges") >= F.lit(charge)))


def escalated_at_risk(scored: DataFrame, threshold: float = V.DECISION_THRESHOLD) -> DataFrame:
    return scored.where((F.col("escalation_flag") == 1) & (F.col("churn_score") >= F.lit(threshold)))


def first_answers(rows: DataFrame, key: str = "customerID", n: int = 3) -> DataFrame:
    """The few rows an answer quotes, with the number of all that match."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(F.col("churn_score").desc(), key).limit(n).withColumn("n_found", total)


def with_customer_id(df: DataFrame, order: str, slices: int | None = None) -> DataFrame:
    """A ``customerID`` in front: as given, renamed from CustomerId, or numbered by ``order``.

    Numbers follow the order column over the whole table; they are made slice by
    slice, so no task sorts everything. ``order`` must be unique.
    """
    if "customerID" not in df.columns:
        if "CustomerId" in df.columns:
            df = df.withColumnRenamed("CustomerId", "customerID")
        else:
            df = _numbered(df, order, slices)
    return df.select("customerID", *[c for c in df.columns if c != "customerID"])


def _numbered(df: DataFrame, order: str, slices: int | None) -> DataFrame:
    keys = settle(df.select(order).withColumn("_one", F.lit(1)))
    places = running_totals(keys, [], order, ["_one"], slices).select(order, (F.col("cum__one") - 1).alias("_place"))
    digits = F.greatest(F.lit(4), F.length(F.col("_place").cast("string")))
    number = F.lpad(F.col("_place").cast("string"), digits, F.lit("0"))
    return df.join(places, order).withColumn("customerID", F.concat(F.lit("CUST-"), number)).drop("_place")
