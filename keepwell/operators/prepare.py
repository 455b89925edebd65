"""Scaling, one-hot columns and the model vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepwell.functions import features as X, values as V

MAX_CATEGORIES = 1000


def fit_scaler(train: DataFrame, columns: list[str] = V.SCALED_COLUMNS) -> DataFrame:
    """(feature, mean, deviation): population deviation, nulls left out, one pass."""
    cells = [F.struct(F.lit(c).alias("feature"), F.avg(X.as_number(train, c)).alias("mean"),
                      F.stddev_pop(X.as_number(train, c)).alias("deviation")) for c in columns]
    return train.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def scale(df: DataFrame, scaler: DataFrame, suffix: str = "") -> DataFrame:
    """Standardises the fitted columns; a constant column is only centred.

    The scaler is one row per column and enters the plan as literals.
    """
    changed = {}
    for r in scaler.collect():
        spread = r.deviation or 1.0
        changed[r.feature + suffix] = (X.as_number(df, r.feature) - F.lit(r["mean"])) / F.lit(spread)
    return df.withColumns(changed)


def fit_categories(train: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted categories per column; refuses a column that is no category."""
    found = {}
    for c in columns:
        values = [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct()
                  .limit(MAX_CATEGORIES + 1).collect()]
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories")
        found[c] = sorted(values)
    return found


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def one_hot(df: DataFrame, categories: dict[str, list[str]] = V.CATEGORY_VALUES) -> DataFrame:
    """``column_value`` indicators; an unseen or missing value is zero everywhere."""
    return df.withColumns({
        f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
        for c, values in categories.items() for v in values})


def feature_vector(df: DataFrame, names: list[str], output: str = "features") -> DataFrame:
    """One array of doubles in the given order, nulls and missing columns as zero."""
    present = set(df.columns)
    parts = [F.coalesce(X.as_number(df, n), F.lit(0.0)) if n in present else F.lit(0.0) for n in names]
    return df.withColumn(output, F.array(*parts))


def model_matrix(df: DataFrame, scaler: DataFrame, categories: dict[str, list[str]] = V.CATEGORY_VALUES,
                 names: list[str] | None = None) -> DataFrame:
    """The same path for training, batch and stream: codes, scaling, one-hot, vector."""
    ready = one_hot(scale(X.model_inputs(df), scaler), categories)
    if names is None:
        names = [*V.SCALED_COLUMNS, *[f"{c}_{v}" for c, vs in categories.items() for v in vs], *V.PLAIN_COLUMNS]
    return feature_vector(ready, names)
