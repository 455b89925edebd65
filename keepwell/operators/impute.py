"""Joining the bank table and filling what it does not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keepwell.functions import values as V
from keepwell.functions.features import as_number
from keepwell.operators.ranking import draw, exact_quantiles, share


def enrich_from_bank(customers: DataFrame, bank: DataFrame, key="customerID", bank_key="CustomerId",
                     columns: list[str] = V.BANK_COLUMNS) -> DataFrame:
    """Left join on the key as text, right side cut to what is used.

    ``bank`` has one row per key. Spark broadcasts it when its measured size allows
    and otherwise splits skewed partitions of the customer side.
    """
    right = bank.select(F.col(bank_key).cast("string").alias(key), *columns)
    return customers.withColumn(key, F.col(key).cast("string")).join(right, key, "left")


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median, deviation, lowest, highest) over all rows, nulls left out."""
    cells = [F.struct(F.lit(c).alias("feature"), as_number(df, c).alias("value")) for c in columns]
    medians = exact_quantiles(
        df.select(F.inline(F.array(*cells))).where("value IS NOT NULL"), "feature", [0.5])
    spread = [F.struct(
        F.lit(c).alias("feature"), F.stddev_samp(as_number(df, c)).alias("deviation"),
        F.min(as_number(df, c)).alias("lowest"), F.max(as_number(df, c)).alias("highest")) for c in columns]
    return (
        df.agg(F.array(*spread).alias("cells")).select(F.inline("cells"))
        .join(F.broadcast(medians), "feature")
        .select("feature", F.col("quantile").alias("median"), "deviation", "lowest", "highest")
    )


def impute(df: DataFrame, statistics: DataFrame, columns: list[str], key: str = "customerID",
           whole: list[str] = V.WHOLE_NUMBER_BANK_COLUMNS, jitter_seed: str | None = None) -> DataFrame:
    """Nulls become the median, or with a seed a clipped normal draw around it.

    The statistics are one row per column; they are read on the driver and enter
    the plan as literals, so the table itself is only projected.
    """
    known = {r.feature: r for r in statistics.where(F.col("feature").isin(columns)).collect()}
    filled = {}
    for c in columns:
        stat = known.get(c)
        if stat is None:
            continue
        fill = F.lit(stat["median"])
        if jitter_seed is not None and stat.deviation:
            # Box-Muller on two drawn shares: repeatable on any partitioning
            u = F.greatest(share(draw(f"{jitter_seed}:{c}:radius", F.col(key))), F.lit(1e-12))
            v = share(draw(f"{jitter_seed}:{c}:angle", F.col(key)))
            normal = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
            fill = F.least(F.lit(stat.highest), F.greatest(
                F.lit(stat.lowest), F.lit(stat["median"]) + normal * (stat.deviation * 0.5)))
        if c in whole:
            fill = F.bround(fill, 0)
        filled[c] = F.coalesce(as_number(df, c), fill)
    return df.withColumns(filled)
