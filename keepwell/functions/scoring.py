"""The rule scorecard, confidence, risk level and its additive contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keepwell.functions import values as V

# fixed values: scorecard points and limits
BASE_SCORE = 0.15
MONTHLY_CONTRACT_POINTS = 0.35
NEW_CUSTOMER_POINTS, NEW_CUSTOMER_MONTHS = 0.25, 6
FIBER_POINTS = 0.12
LOWEST_SCORE, HIGHEST_SCORE = 0.04, 0.96


def points(inputs: dict[str, Column] | None = None) -> dict[str, Column]:
    """Points per feature, named as the features are; ``inputs`` replaces columns."""
    def given(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    x = {c: F.col(c) for c in ("Contract", "tenure", "InternetService")} | (inputs or {})
    return {
        "contract_type_encoded": given(x["Contract"] == "Month-to-month", MONTHLY_CONTRACT_POINTS),
        "tenure": given(x["tenure"] <= NEW_CUSTOMER_MONTHS, NEW_CUSTOMER_POINTS),
        "InternetService_Fiber optic": given(x["InternetService"] == "Fiber optic", FIBER_POINTS),
    }


def from_points(parts: list[Column]) -> Column:
    total = F.lit(BASE_SCORE)
    for part in parts:
        total = total + part
    return F.least(F.lit(HIGHEST_SCORE), F.greatest(F.lit(LOWEST_SCORE), total))


def scorecard(inputs: dict[str, Column] | None = None) -> Column:
    return from_points(list(points(inputs).values()))


def confidence(p: Column, threshold: float = V.DECISION_THRESHOLD) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(p - F.lit(threshold)) * 2.0))


def risk_level(p: Column, threshold: float = V.DECISION_THRESHOLD) -> Column:
    return F.when(p >= F.lit(threshold), "High Risk").otherwise("Low Risk")


def scored(df: DataFrame, threshold: float = V.DECISION_THRESHOLD) -> DataFrame:
    p = F.col("churn_score")
    return df.withColumn("churn_score", scorecard()).withColumns({
        "confidence": confidence(p, threshold),
        "risk_level": risk_level(p, threshold),
        "action_needed": (p >= F.lit(threshold)).cast("int"),
    })
