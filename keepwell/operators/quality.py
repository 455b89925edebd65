"""Data-quality checks: one pass per table, one row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from keepwell.functions import features, values as V


class QualityError(ValueError):
    """A gate failed; the message lists every finding."""


def one_row_each(totals: DataFrame, rows: list[tuple[str, Column]], *, label: str, value: str) -> DataFrame:
    """Turns a one-row table of totals into (label, value) rows without a second pass."""
    cells = [F.struct(F.lit(name).alias(label), cell.alias(value)) for name, cell in rows]
    return totals.select(F.inline(F.array(*cells)))


def coerce_totals(df: DataFrame, total="TotalCharges", tenure="tenure", monthly="MonthlyCharges") -> DataFrame:
    return df.withColumn(total, features.total_charges(F.col(total), F.col(tenure), F.col(monthly)))


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in the given order, with ``n_dups``, the rows dropped for it.

    An aggregate instead of a window: partial results are merged before the
    shuffle, so a key with a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order))
    grouped = df.groupBy(key).agg(first.alias("_first"), (F.count("*") - 1).alias("n_dups"))
    return grouped.select(
        *[F.col(key) if c == key else F.col(f"_first.`{c}`") for c in df.columns], "n_dups")


def keep_labelled(df: DataFrame, label: str, valid: tuple[str, ...] = ("Yes", "No")) -> DataFrame:
    return df.where(F.col(label).isin(*valid))


def label_report(df: DataFrame, label: str, valid: tuple[str, ...] = ("Yes", "No")) -> DataFrame:
    good = F.coalesce(F.col(label).isin(*valid), F.lit(False))
    return df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def outside(column: str, low: float, high: float) -> Column:
    """True for values outside the range; null and NaN are not flagged."""
    x = F.col(column).cast("double")
    return F.coalesce(~F.isnan(x) & ((x < low) | (x > high)), F.lit(False))


def with_range_flags(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{c}_out_of_range": outside(c, *r) for c, r in ranges.items()})


def range_report(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    totals = df.agg(*[F.count_if(outside(c, *r)).alias(f"n{i}") for i, (c, r) in enumerate(ranges.items())])
    return one_row_each(totals, [(c, F.col(f"n{i}")) for i, c in enumerate(ranges)],
                        label="column_name", value="n_out")


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Share of distinct left keys that also occur right; keys compare as text."""
    if left_key not in left.columns or right_key not in right.columns:
        spark = left.sparkSession
        return spark.sql("SELECT 0L AS n_left, 0L AS n_right, 0L AS n_both, 0.0D AS rate, true AS warn")
    key = F.col("key")
    l = left.select(F.col(left_key).cast("string").alias("key")).where(key.isNotNull())
    r = right.select(F.col(right_key).cast("string").alias("key")).where(key.isNotNull())
    sides = (
        l.select("key", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(r.select("key", F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    counted = sides.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_right"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("n_both"),
    )
    rate = F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col("n_left")), F.lit(0.0))
    return counted.withColumn("rate", rate).withColumn("warn", F.col("rate") < V.MIN_KEY_OVERLAP)


def null_rates(df: DataFrame, limit: float = V.MAX_NULL_RATE) -> DataFrame:
    """(column_name, value, failed) for every column, from one aggregate."""
    totals = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"r{i}") for i, c in enumerate(df.columns)])
    out = one_row_each(totals, [(c, F.coalesce(F.col(f"r{i}"), F.lit(0.0))) for i, c in enumerate(df.columns)],
                       label="column_name", value="value")
    return out.withColumn("failed", (F.col("value") > limit).cast("int"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def zero_variance(df: DataFrame, exempt: list[str] = V.CONSTANT_BY_DESIGN) -> DataFrame:
    """Sample deviation per numeric column; fails where all values are equal.

    Equality is tested by min = max, which rounding cannot disturb. Fewer than two
    values have no deviation and pass.
    """
    names = [c for c in numeric_columns(df) if c not in exempt]
    aggs = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.stddev_samp(x).alias(f"s{i}"),
                 ((F.count(x) > 1) & (F.min(x) == F.max(x))).alias(f"f{i}")]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("value"),
                      F.coalesce(F.col(f"f{i}"), F.lit(False)).cast("int").alias("failed"))
             for i, c in enumerate(names)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def target_leakage(df: DataFrame, label: str, limit: float = V.MAX_LABEL_CORRELATION) -> DataFrame:
    """|Pearson r| with the label per numeric column; a constant column has none."""
    names = [c for c in numeric_columns(df) if c != label]
    y = F.col(label).cast("double")
    aggs = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        xb, yb = F.when(both, x), F.when(both, y)
        spread = F.nullif(F.stddev_samp(xb) * F.stddev_samp(yb), F.lit(0.0))
        aggs.append(F.abs(F.covar_samp(xb, yb) / spread).alias(f"r{i}"))
    out = one_row_each(df.agg(*aggs), [(c, F.col(f"r{i}")) for i, c in enumerate(names)],
                       label="column_name", value="value")
    return out.withColumn("failed", F.coalesce(F.col("value") > limit, F.lit(False)).cast("int"))


def quality_report(df: DataFrame, label: str, exempt: list[str] = V.CONSTANT_BY_DESIGN) -> DataFrame:
    """(check_name, n_failed, failed) for the three gates."""
    parts = {
        "null_rate": null_rates(df),
        "zero_variance": zero_variance(df, exempt),
        "target_leakage": target_leakage(df, label),
    }
    rows = [p.agg(F.sum("failed").alias("n_failed")).select(F.lit(name).alias("check_name"), "n_failed")
            for name, p in parts.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("failed", (F.col("n_failed") > 0).cast("int"))


def verdict(report: DataFrame) -> Column:
    """PASSED, or FAILED if any gate of the report failed."""
    return F.when(report.agg(F.max("failed")).scalar() == 1, "FAILED").otherwise("PASSED")


def require_quality(df: DataFrame, label: str, exempt: list[str] = V.CONSTANT_BY_DESIGN) -> None:
    """Raises with every finding; the verdict rows are one per column, never data."""
    found = (
        null_rates(df).withColumn("check_name", F.lit("null_rate"))
        .unionByName(zero_variance(df, exempt).withColumn("check_name", F.lit("zero_variance")))
        .unionByName(target_leakage(df, label).withColumn("check_name", F.lit("target_leakage")))
        .where("failed = 1").collect()
    )
    if found:
        raise QualityError("; ".join(f"{r.check_name}: {r.column_name} ({r.value})" for r in found))
