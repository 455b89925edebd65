"""Model metrics from scored rows, each from counts per score or per threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keepwell.functions import values as V
from keepwell.operators.ranking import running_totals
from keepwell.session import settle

# fixed values: thresholds tried, in hundredths, and the impact figures
FIRST_STEP, LAST_STEP = 10, 89
LIFETIME_MONTHS = 24
OPERATING_COST = 60000.0


def confusion(label: Column, p: Column, threshold: float | Column) -> dict[str, Column]:
    t = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    hit, yes = p >= t, label == 1
    return {
        "tn": F.count_if(~hit & ~yes), "fp": F.count_if(hit & ~yes),
        "fn": F.count_if(~hit & yes), "tp": F.count_if(hit & yes),
    }


def confusion_at(scored: DataFrame, label: str, p: str, threshold: float,
                 group: list[str] | None = None) -> DataFrame:
    cells = confusion(F.col(label), F.col(p), threshold)
    return scored.groupBy(*(group or [])).agg(*[c.alias(n) for n, c in cells.items()]).withColumn(
        "recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


def score_counts(scored: DataFrame, label: str, p: str, group: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score, written once for the curves."""
    return settle(
        scored.where(F.col(p).isNotNull() & F.col(label).isNotNull())
        .groupBy(*(group or []), F.col(p).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def ranking_curves(counts: DataFrame, group: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """ROC and precision-recall areas per group.

    Both are sums over distinct scores: a score's point and its neighbour at the
    next higher score follow from the running totals, so no second ordering is
    needed. Equal scores count half; the recall axis starts at precision 1.
    """
    group = group or []
    t = running_totals(counts, group, "score", ["pos", "neg"], slices)
    P, N, pos, neg = F.col("all_pos"), F.col("all_neg"), F.col("pos"), F.col("neg")
    below = (F.col("cum_neg") - neg).cast("double")
    above_pos = (P - F.col("cum_pos")).cast("double")
    above_neg = (N - F.col("cum_neg")).cast("double")

    def precision(tp: Column, fp: Column) -> Column:
        return F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))

    strip = pos * (precision(above_pos + pos, above_neg + neg) + precision(above_pos, above_neg)) / 2.0
    return t.groupBy(*group).agg(
        F.try_divide(F.sum(pos * (below + neg / 2.0)), F.max(P).cast("double") * F.max(N)).alias("roc_auc"),
        F.try_divide(F.sum(strip), F.max(P).cast("double")).alias("pr_auc"),
        F.coalesce(F.sum(pos), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(neg), F.lit(0)).alias("n_neg"),
    )


def roc_auc(scored: DataFrame, label: str, p: str, group: list[str] | None = None) -> DataFrame:
    out = ranking_curves(score_counts(scored, label, p, group), group)
    return out.select(*(group or []), "roc_auc", "n_pos", "n_neg")


def pr_auc(scored: DataFrame, label: str, p: str, group: list[str] | None = None) -> DataFrame:
    out = ranking_curves(score_counts(scored, label, p, group), group)
    return out.select(*(group or []), "pr_auc", "n_pos", "n_neg")


def _step(p: Column) -> Column:
    """The largest i with i / 100 <= p, corrected for rounding of p * 100."""
    guess = F.floor(p * 100.0)
    return (F.when((guess + 1) / 100.0 <= p, guess + 1)
            .when(guess / 100.0 > p, guess - 1).otherwise(guess))


def cost_curve(scored: DataFrame, label: str, p: str, missed_cost: float = V.MISSED_CHURNER_COST,
               contact_cost: float = V.CONTACT_COST) -> DataFrame:
    """Cost and confusion counts of 80 thresholds; the lowest threshold wins a tie.

    Rows are counted per hundredth of the score (about a hundred rows survive) and
    the thresholds are evaluated on that array.
    """
    steps = scored.groupBy(_step(F.col(p)).alias("step")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    one = steps.agg(F.collect_list(F.struct("step", "pos", "neg")).alias("steps"))

    def total(name: str, keep) -> Column:
        return F.aggregate("steps", F.lit(0).cast("long"),
                           lambda acc, s: acc + F.when(keep(s["step"]), s[name]).otherwise(0))

    def at(t: Column) -> Column:
        fn, fp = total("pos", lambda s: s < t), total("neg", lambda s: s >= t)
        return F.struct(
            (fn * missed_cost + fp * contact_cost).cast("double").alias("cost"),
            t.cast("int").alias("step"), fn.alias("fn"), fp.alias("fp"),
            total("pos", lambda s: s >= t).alias("tp"), total("neg", lambda s: s < t).alias("tn"))

    curve = one.select(F.transform(F.sequence(F.lit(FIRST_STEP), F.lit(LAST_STEP)), at).alias("curve"))
    best = F.array_min("curve")["step"].alias("best")
    return curve.select(best, F.inline("curve")).select(
        (F.col("step") / 100.0).alias("threshold"), "cost", "fn", "fp", "tp", "tn",
        (F.col("step") == F.col("best")).cast("int").alias("is_best"))


def business_impact(scored: DataFrame, label: str, p: str, monthly: str,
                    scenarios: dict[str, float], contact_cost: float = V.CONTACT_COST,
                    operating_cost: float = OPERATING_COST) -> DataFrame:
    """Cost of each threshold, saving against the first scenario, net saving and return."""
    cells = {f"{name}_{i}": c for i, t in enumerate(scenarios.values())
             for name, c in confusion(F.col(label), F.col(p), t).items()}
    totals = scored.agg((F.avg(monthly) * LIFETIME_MONTHS).alias("ltv"),
                        *[c.alias(n) for n, c in cells.items()])

    def cost(i: int) -> Column:
        return F.col(f"fn_{i}") * F.col("ltv") + F.col(f"fp_{i}") * contact_cost

    rows = [
        F.struct(
            F.lit(name).alias("scenario"), F.lit(t).alias("threshold"), F.col("ltv"),
            F.col(f"fn_{i}").alias("fn"), F.col(f"fp_{i}").alias("fp"), cost(i).alias("cost"),
            (cost(0) - cost(i)).alias("saving"),
            F.try_divide((cost(0) - cost(i)) * 100.0, cost(0)).alias("saving_pct"),
            (F.col(f"tp_{i}") * F.col("ltv") - (F.col(f"tp_{i}") + F.col(f"fp_{i}")) * contact_cost
             - operating_cost).alias("net_saving"),
        ) for i, (name, t) in enumerate(scenarios.items())
    ]
    return totals.select(F.inline(F.array(*rows))).withColumn(
        "roi_pct", F.col("net_saving") / operating_cost * 100.0)


def model_comparison(scored: DataFrame, model: str, label: str, p: str, threshold: float,
                     missed_cost: float = V.MISSED_CHURNER_COST,
                     contact_cost: float = V.CONTACT_COST) -> DataFrame:
    """ROC, PR, recall and cost per model from one long table of scores."""
    curves = ranking_curves(score_counts(scored, label, p, [model]), [model])
    cost = F.col("fn") * missed_cost + F.col("fp") * contact_cost
    at = confusion_at(scored, label, p, threshold, [model]).select(
        model, "recall", cost.cast("double").alias("cost"))
    return curves.select(model, "roc_auc", "pr_auc").join(at, model)


def promotion_gate(metrics: DataFrame, model: str, production: str | None = None,
                   margin: float = V.PROMOTION_MARGIN, min_roc: float = V.PROMOTION_MIN_ROC,
                   min_recall: float = V.PROMOTION_MIN_RECALL) -> DataFrame:
    """One row per candidate with each gate; without production its ROC-AUC is 0.5.

    ``safety_ok`` alone decides as the retraining job does; ``passes`` adds the
    documented absolute gates.
    """
    current = metrics.where(F.col(model) == production).agg(
        F.struct(F.coalesce(F.max("roc_auc"), F.lit(0.5)).alias("roc"),
                 F.coalesce(F.max("pr_auc"), F.lit(0.0)).alias("pr"))).scalar()
    judged = metrics.where(F.col(model) != F.lit(production)) if production else metrics
    gates = {
        "safety_ok": F.col("roc_auc") >= current["roc"] - margin,
        "roc_ok": F.col("roc_auc") >= min_roc,
        "pr_ok": F.col("pr_auc") >= current["pr"] * (1 - margin),
        "recall_ok": F.col("recall") > min_recall,
    }
    out = judged.withColumns({n: F.coalesce(g, F.lit(False)).cast("int") for n, g in gates.items()})
    return out.withColumn("passes", F.least(*gates))
