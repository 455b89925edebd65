"""Distribution drift, decay of a model's ranking, and the retraining trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keepwell.functions import values as V
from keepwell.functions.features import finite
from keepwell.operators.metrics import ranking_curves
from keepwell.operators.ranking import exact_quantiles, passed_cuts
from keepwell.session import settle


def _long(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), finite(F.col(f"`{c}`")).alias("value")) for c in columns]
    return df.select(F.lit(side).alias("side"), F.inline(F.array(*cells))).where("value IS NOT NULL")


SKETCH_SIZE = 2000


def feature_sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, sketch): one pass over a table, nothing unpivoted; sketches of several tables can be merged."""
    values = [finite(F.col(f"`{c}`")).cast("double") for c in columns]
    row = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE)).alias("sketch"))
                   .alias(f"f{i}") for i, (c, v) in enumerate(zip(columns, values))])
    return row.select(F.inline(F.array(*[f"f{i}" for i in range(len(columns))])))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of a union of tables, from those of its parts."""
    return sketches.where("n > 0").groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _edges(baseline: DataFrame, bins: int, sketches: DataFrame | None = None) -> DataFrame:
    """(feature, _m, _edge): the exact quantiles of a baseline, without repeats, the outer ones moved out a little."""
    cuts = exact_quantiles(baseline.select("feature", "value"), "feature", [i / bins for i in range(bins + 1)], sketches=sketches)
    m = F.col("_m")
    return (
        cuts.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("_cut"))
        .withColumn("_m", F.size("_cut"))
        .withColumn("_edge", F.transform("_cut", lambda e, i: F.when(i == 0, e - V.PSI_EDGE_MARGIN)
                                         .when(i == m - 1, e + V.PSI_EDGE_MARGIN).otherwise(e)))
        .drop("_cut")
    )


def _binned(rows: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """``rows`` with _m and _bin, the number of edges at or below the value; the last bin is closed."""
    m, value = F.col("_m"), F.col("value")
    placed = passed_cuts(F.col("_edge"), value, bins + 1, closed=True)
    at = F.when(value == F.get("_edge", m - 1), m - 1).otherwise(placed)
    return rows.join(F.broadcast(edges), "feature").withColumn("_bin", at)


def _weighed(bins: Column, nb: Column, nt: Column) -> Column:
    """The index from (b, t) counts per bin; a share of 0 counts as the floor."""
    def part(b, t):
        b, t = [F.when(x == 0, F.lit(V.PSI_FLOOR)).otherwise(x) for x in (b, t)]
        return (t - b) * F.log(t / b)

    return F.aggregate(bins, F.lit(0.0), lambda acc, c: acc + part(
        F.try_divide(c["b"].cast("double"), nb), F.try_divide(c["t"].cast("double"), nt)))


def _of_columns(found: DataFrame, columns: list[str]) -> DataFrame:
    asked = found.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return F.broadcast(asked).join(found, "feature", "left").na.fill(0.0, ["psi"])


def stability_index(baseline: DataFrame, target: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Population stability index per feature: (feature, psi).

    Cut points are the exact baseline quantiles. Shares are taken over all values,
    so target values outside the baseline range lie in no bin. Tables should be
    stored ones: the baseline is scanned for the quantiles and both for the counts,
    which merge before the only shuffle.
    """
    base = _long(baseline, columns, "baseline")
    both = base.unionByName(_long(target, columns, "target"))
    counts = _binned(both, _edges(base, bins), bins).groupBy("feature", "_m", "_bin").agg(
        F.count_if(F.col("side") == "baseline").alias("b"), F.count_if(F.col("side") == "target").alias("t"))
    m, inside = F.col("_m"), F.col("_bin").between(1, F.col("_m") - 1)
    per_feature = counts.groupBy("feature", "_m").agg(
        F.sum("b").alias("_nb"), F.sum("t").alias("_nt"),
        F.collect_list(F.when(inside, F.struct("b", "t"))).alias("_bins"))
    usable = (m >= 2) & (F.col("_nb") > 0) & (F.col("_nt") > 0)
    # a bin empty on both sides weighs nothing: both shares are the floor
    filled = _weighed(F.col("_bins"), F.col("_nb"), F.col("_nt"))
    return _of_columns(per_feature.select("feature", F.when(usable, filled).otherwise(F.lit(0.0)).alias("psi")), columns)


def baseline_bins(baseline: DataFrame, columns: list[str], bins: int = 10, sketches: DataFrame | None = None) -> DataFrame:
    """(feature, _m, _edge, _nb, _b): what a baseline is compared by, one row per feature, to be stored.

    ``sketches`` are those of ``feature_sketches``, merged if the baseline has several
    parts; with them the first scan is saved.
    """
    base = _long(baseline, columns, "baseline").select("feature", "value")
    edges = settle(_edges(base, bins, sketches), "edges")
    counts = _binned(base, edges, bins).groupBy("feature", "_bin").agg(F.count("*").alias("b"))
    per_feature = counts.groupBy("feature").agg(
        F.sum("b").alias("_nb"), F.map_from_entries(F.collect_list(F.struct("_bin", "b"))).alias("_b"))  # a row per bin
    return edges.join(per_feature, "feature")


def stability_against(stored: DataFrame, target: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """``stability_index`` against stored ``baseline_bins``: the target is scanned once, the baseline not at all."""
    rows = _long(target, columns, "target").select("feature", "value")
    counts = _binned(rows, stored.select("feature", "_m", "_edge"), bins).groupBy("feature", "_bin").agg(F.count("*").alias("t"))
    seen = counts.groupBy("feature").agg(
        F.sum("t").alias("_nt"), F.map_from_entries(F.collect_list(F.struct("_bin", "t"))).alias("_t"))
    pair = lambda i: F.struct(F.coalesce(F.col("_b")[i], F.lit(0)).alias("b"), F.coalesce(F.col("_t")[i], F.lit(0)).alias("t"))
    pairs = F.transform(F.sequence(F.lit(1), F.col("_m") - 1), pair)
    found = stored.join(seen, "feature").select("feature", F.when(F.col("_m") >= 2, _weighed(pairs, F.col("_nb"), F.col("_nt")))
                                                .otherwise(F.lit(0.0)).alias("psi"))
    return _of_columns(found, columns)


def with_status(psi: DataFrame) -> DataFrame:
    return psi.withColumn("status", F.when(F.col("psi") > V.PSI_ALERT, "RED")
                          .when(F.col("psi") > V.PSI_WARN, "YELLOW").otherwise("STABLE"))


def status_counts(psi: DataFrame) -> DataFrame:
    return psi.agg(
        F.count_if(F.col("psi") > V.PSI_ALERT).alias("n_red"),
        F.count_if((F.col("psi") > V.PSI_WARN) & (F.col("psi") <= V.PSI_ALERT)).alias("n_yellow"),
        F.avg("psi").alias("mean_psi"))


def top_drifted(psi: DataFrame, n: int = 5) -> DataFrame:
    return psi.orderBy(F.col("psi").desc(), "feature").limit(n)


def model_decay(outcomes: DataFrame, scores: DataFrame, key: str, baseline_auc: float = 0.85,
                min_rows: int = V.MIN_DECAY_ROWS, limit: float = V.MAX_AUC_DECAY,
                time: str | None = None, as_of: str | None = None, days: int = 30) -> DataFrame:
    """AUC of the scores against logged outcomes: (n_outcomes, n_scored, auc, decay, alert).

    Scores are matched by key and the coverage is reported. A log with one class
    gives the baseline; fewer rows than ``min_rows`` give no verdict.
    """
    log = outcomes.where("outcome IS NOT NULL")
    if time is not None:
        log = log.where((F.col(time) > F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"))
                        & (F.col(time) <= F.expr(f"timestamp_ntz'{as_of}'")))
    # attempts per customer and result come first: a busy customer is two rows
    per_customer = log.groupBy(F.col("customer_id").alias(key)).agg(
        F.count_if(F.col("outcome") == 0).alias("lost"), F.count_if(F.col("outcome") != 0).alias("kept"))
    matched = per_customer.join(scores.select(key, "churn_score"), key, "left")
    counts = settle(matched.groupBy(F.col("churn_score").cast("double").alias("score")).agg(
        F.sum("lost").alias("pos"), F.sum("kept").alias("neg")))
    logged = counts.agg(F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0))).scalar()
    curve = ranking_curves(counts.where("score IS NOT NULL"))
    enough = F.col("n_outcomes") >= min_rows
    return (
        curve.select(logged.alias("n_outcomes"), (F.col("n_pos") + F.col("n_neg")).alias("n_scored"),
                     F.coalesce("roc_auc", F.lit(baseline_auc)).alias("_auc"))
        .withColumn("auc", F.when(enough, F.col("_auc")))
        .withColumn("decay", (F.lit(baseline_auc) - F.col("auc")) / baseline_auc)
        .withColumn("alert", F.coalesce(F.col("decay") > limit, F.lit(False)).cast("int"))
        .drop("_auc")
    )


def retrain_trigger(psi: DataFrame, decay: DataFrame, limit: float = V.PSI_ALERT) -> DataFrame:
    """Fires on any feature beyond the limit or on decay; pass PSI_WARN to include warnings."""
    decayed = decay.agg(F.coalesce(F.max("alert"), F.lit(0))).scalar()
    return psi.agg(F.count_if(F.col("psi") > limit).alias("n_drifted")).withColumn("decayed", decayed).withColumn(
        "fire", ((F.col("n_drifted") > 0) | (F.col("decayed") == 1)).cast("int"))
