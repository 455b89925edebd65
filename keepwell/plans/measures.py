"""Model metrics, drift, outcomes and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.operators import drift, metrics, outcomes, reports
from keepwell.plans import views as D
from keepwell.session import settle
from keepwell.plans.registry import query, rounded


def _confusion(t: str, y: str = "y", p: str = "p") -> str:
    return (f"count(*) FILTER ({p} < {t} AND {y} = 0) AS tn, count(*) FILTER ({p} >= {t} AND {y} = 0) AS fp, "
            f"count(*) FILTER ({p} < {t} AND {y} = 1) AS fn, count(*) FILTER ({p} >= {t} AND {y} = 1) AS tp")


@query("confusion_at_t", f"""WITH {D.GRADED}
SELECT *, round(tp / (tp + fn)::DOUBLE, 6) AS recall FROM (SELECT {_confusion("0.32::DOUBLE")} FROM graded)""")
def confusion_at_t(spark, sf):
    return rounded(metrics.confusion_at(D.graded_documents(spark, sf), "y", "p", 0.32))


def _roc(source: str, y: str = "y", p: str = "p", by: str = "") -> str:
    """Rank-sum form, with equal scores at their mean rank."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}(sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0)::DOUBLE AS roc_auc,
      n1 AS n_pos, n0 AS n_neg
    FROM (SELECT *, count(*) FILTER (y = 1) OVER ({part}) AS n1, count(*) FILTER (y = 0) OVER ({part}) AS n0
      FROM (SELECT {keys}{y} AS y, {p} AS p, rank() OVER ({part} ORDER BY {p})
        + (count(*) OVER (PARTITION BY {keys}{p}) - 1) / 2.0::DOUBLE AS r FROM {source}))
    GROUP BY {keys}n1, n0"""


def _pr(source: str, y: str = "y", p: str = "p", by: str = "") -> str:
    """Trapezoids between consecutive thresholds, from (recall 0, precision 1)."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}sum((recall - coalesce(lag_r, 0)) * (prec + coalesce(lag_p, 1)) / 2.0::DOUBLE) AS pr_auc,
      max(tp) AS n_pos, max(n) - max(tp) AS n_neg
    FROM (SELECT *, lag(recall) OVER w AS lag_r, lag(prec) OVER w AS lag_p FROM (
      SELECT *, tp / n::DOUBLE AS prec, tp / (max(tp) OVER ({part}))::DOUBLE AS recall FROM (
        SELECT {keys}p, sum(pos) OVER w AS tp, sum(c) OVER w AS n FROM (
          SELECT {keys}{p} AS p, count(*) FILTER ({y} = 1) AS pos, count(*) AS c FROM {source} GROUP BY {keys}{p})
        WINDOW w AS ({part} ORDER BY p DESC)))
      WINDOW w AS ({part} ORDER BY p DESC))
    {"GROUP BY " + by if by else ""}"""


@query("roc_auc", f"""WITH {D.GRADED}
SELECT round(roc_auc, 6) AS roc_auc, n_pos, n_neg FROM ({_roc("graded")})""")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(D.graded_documents(spark, sf), "y", "p"))


@query("pr_auc", f"""WITH {D.GRADED}
SELECT round(pr_auc, 6) AS pr_auc, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg FROM ({_pr("graded")})""")
def pr_auc(spark, sf):
    return rounded(metrics.pr_auc(D.graded_documents(spark, sf), "y", "p"))


@query("roc_auc_by_contract", f"""WITH {D.SCORED}, rows AS (
  SELECT coalesce("Contract", 'none') AS contract, "Churn" AS y, "MonthlyCharges" / 100.0::DOUBLE AS p FROM scored)
SELECT contract, round(roc_auc, 6) AS roc_auc, n_pos, n_neg FROM ({_roc("rows", by="contract")})""")
def roc_auc_by_contract(spark, sf):
    rows = D.customers(spark, sf, churn=True, accounts=False).select(
        F.coalesce("Contract", F.lit("none")).alias("contract"), F.col("Churn").alias("y"),
        (F.col("MonthlyCharges") / 100.0).alias("p"))
    return rounded(metrics.roc_auc(rows, "y", "p", ["contract"]))


@query("roc_auc_by_group_sliced", f"""WITH {D.SCORED}, rows AS (
  SELECT "Contract" AS contract, "Churn" AS y, "MonthlyCharges" / 100.0::DOUBLE AS p FROM scored)
SELECT contract, round(roc_auc, 6) AS roc_auc, n_pos, n_neg FROM ({_roc("rows", by="contract")})""")
def roc_auc_by_group_sliced(spark, sf):
    """The same curve with the order cut into slices, over groups of which one is null."""
    rows = D.customers(spark, sf, churn=True, accounts=False).select(
        F.col("Contract").alias("contract"), F.col("Churn").alias("y"), (F.col("MonthlyCharges") / 100.0).alias("p"))
    counts = metrics.score_counts(rows, "y", "p", ["contract"])
    return rounded(metrics.ranking_curves(counts, ["contract"], slices=7).drop("pr_auc"))


@query("numbered_customers", """
SELECT 'CUST-' || lpad((row_number() OVER (ORDER BY c_name) - 1)::VARCHAR, greatest(4, len((row_number() OVER (ORDER BY c_name) - 1)::VARCHAR))::INT, '0')
  AS "customerID", c_name FROM customer""")
def numbered_customers(spark, sf):
    return reports.with_customer_id(D.table(spark, sf, "customer").select("c_name"), "c_name", slices=5)


@query("threshold_cost", f"""WITH {D.GRADED},
curve AS (
  SELECT i, {_confusion("i / 100.0::DOUBLE")} FROM graded, range(10, 90) AS steps(i) GROUP BY i),
priced AS (SELECT *, (fn * 1680 + fp * 50)::DOUBLE AS cost FROM curve)
SELECT i / 100.0::DOUBLE AS threshold, cost, fn, fp, tp, tn,
  CASE WHEN i = (SELECT i FROM priced ORDER BY cost, i LIMIT 1) THEN 1 ELSE 0 END AS is_best FROM priced""")
def threshold_cost(spark, sf):
    return metrics.cost_curve(D.graded_documents(spark, sf), "y", "p")


def _scenario(name: str, t: float) -> str:
    return f"""SELECT '{name}' AS scenario, {t}::DOUBLE AS threshold, avg("MonthlyCharges") * 24 AS ltv,
      {_confusion(f"{t}::DOUBLE", '"Churn"')} FROM scored"""


@query("business_impact", f"""WITH {D.SCORED},
cells AS ({_scenario("standard", 0.5)} UNION ALL {_scenario("cost_optimised", 0.32)}),
priced AS (SELECT *, fn * ltv + fp * 50.0::DOUBLE AS cost FROM cells),
saved AS (SELECT *, (SELECT cost FROM priced WHERE scenario = 'standard') AS first_cost,
  tp * ltv - (tp + fp) * 50.0::DOUBLE - 60000.0::DOUBLE AS net FROM priced)
SELECT scenario, threshold, round(ltv, 3) AS ltv, fn, fp, round(cost, 3) AS cost, round(first_cost - cost, 3) AS saving,
  round((first_cost - cost) * 100.0::DOUBLE / first_cost, 3) AS saving_pct, round(net, 3) AS net_saving,
  round(net / 60000.0::DOUBLE * 100.0::DOUBLE, 3) AS roi_pct FROM saved""")
def business_impact(spark, sf):
    rows = D.scored_customers(spark, sf, churn=True)
    return rounded(metrics.business_impact(rows, "Churn", "churn_score", "MonthlyCharges",
                                           {"standard": 0.5, "cost_optimised": 0.32}), 3)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SPLIT_DAY = "1998-01-01"


def _psi_sql() -> str:
    long = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, l_shipdate < TIMESTAMP '{_SPLIT_DAY}' AS base, {c} AS v FROM lineitem"
        for c in _MEASURES)
    probs = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
    return f"""long AS ({long}),
edges AS (
  SELECT feature, list_sort(list_distinct(quantile_cont(v, {probs}))) AS e FROM long WHERE base GROUP BY feature),
bins AS (
  SELECT feature, i, CASE WHEN i = 1 THEN e[1] - 1e-5::DOUBLE ELSE e[i] END AS lo,
    CASE WHEN i = len(e) - 1 THEN e[i + 1] + 1e-5::DOUBLE ELSE e[i + 1] END AS hi, i = len(e) - 1 AS is_last
  FROM (SELECT feature, e, unnest(range(1, len(e))) AS i FROM edges)),
sizes AS (SELECT feature, count(*) FILTER (base) AS nb, count(*) FILTER (NOT base) AS nt FROM long GROUP BY feature),
shares AS (
  SELECT b.feature, b.i, count(v) FILTER (base) / any_value(nb)::DOUBLE AS ps,
    count(v) FILTER (NOT base) / any_value(nt)::DOUBLE AS pt
  FROM bins b JOIN sizes s USING (feature)
  LEFT JOIN long l ON l.feature = b.feature AND v >= lo AND (v < hi OR (is_last AND v = hi))
  GROUP BY b.feature, b.i),
floored AS (
  SELECT feature, CASE WHEN ps = 0 THEN 1e-4::DOUBLE ELSE ps END AS ps,
    CASE WHEN pt = 0 THEN 1e-4::DOUBLE ELSE pt END AS pt FROM shares),
psi AS (SELECT feature, sum((pt - ps) * ln(pt / ps)) AS psi FROM floored GROUP BY feature)"""


_PSI = _psi_sql()


def _psi(spark, sf):
    rows = D.table(spark, sf, "lineitem")
    before = F.col("l_shipdate") < F.lit(f"{_SPLIT_DAY} 00:00:00").cast("timestamp_ntz")
    return drift.stability_index(rows.where(before), rows.where(~before), _MEASURES)


@query("psi", f"WITH {_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi(spark, sf):
    return rounded(_psi(spark, sf))


@query("psi_stored_baseline", f"WITH {_PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_stored_baseline(spark, sf):
    """The same index from a stored baseline of two parts, whose sketches are merged; the target alone is scanned for it."""
    rows = D.table(spark, sf, "lineitem")
    before = F.col("l_shipdate") < F.lit(f"{_SPLIT_DAY} 00:00:00").cast("timestamp_ntz")
    older = F.col("l_shipdate") < F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    parts = [settle(drift.feature_sketches(rows.where(p), _MEASURES), "sketches") for p in (older, before & ~older)]
    merged = settle(drift.merged_sketches(parts[0].unionByName(parts[1])), "merged-sketches")
    stored = settle(drift.baseline_bins(rows.where(before), _MEASURES, sketches=merged), "baseline")
    return rounded(drift.stability_against(stored, rows.where(~before), _MEASURES))


@query("psi_status", f"""WITH {_PSI}
SELECT count(*) FILTER (psi > 0.2) AS n_red, count(*) FILTER (psi > 0.1 AND psi <= 0.2) AS n_yellow,
  round(avg(psi), 6) AS mean_psi FROM psi""")
def psi_status(spark, sf):
    return rounded(drift.status_counts(_psi(spark, sf)))


@query("psi_top5", f"""WITH {_PSI}
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi > 0.2 THEN 'RED' WHEN psi > 0.1 THEN 'YELLOW' ELSE 'STABLE' END
  AS status FROM psi ORDER BY psi DESC, feature LIMIT 5""")
def psi_top5(spark, sf):
    return rounded(drift.top_drifted(drift.with_status(_psi(spark, sf))))


@query("sample_weights", f"""WITH {D.OUTCOMES},
latest AS (SELECT customer_id, outcome FROM (SELECT *, row_number() OVER (
  PARTITION BY customer_id ORDER BY "timestamp" DESC, id DESC) AS place FROM outcomes) WHERE place = 1)
SELECT c_custkey, CASE outcome WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
FROM customer LEFT JOIN latest ON CAST(c_custkey AS VARCHAR) = customer_id""")
def sample_weights(spark, sf):
    rows = D.table(spark, sf, "customer").select("c_custkey")
    return outcomes.sample_weights(rows, D.outcomes(spark, sf), "c_custkey")


@query("class_weights", f"""WITH {D.CUSTOMERS}
SELECT "Churn", count(*) AS n, round((SELECT count(*) FROM customers) / (2.0::DOUBLE * count(*)), 6) AS weight
FROM customers GROUP BY "Churn" """)
def class_weights(spark, sf):
    return rounded(outcomes.class_weights(D.customers(spark, sf, churn=True, accounts=False), "Churn"))


@query("outcome_semi", f"""WITH {D.OUTCOMES}
SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT customer_id FROM outcomes)""")
def outcome_semi(spark, sf):
    rows = D.table(spark, sf, "customer").withColumn("customerID", F.col("c_custkey").cast("string"))
    return outcomes.with_logged_outcome(rows, D.outcomes(spark, sf), "customerID").select("c_custkey", "c_name")


@query("outcome_stats", f"""WITH {D.OUTCOMES}
SELECT count(*) AS n_outcomes, sum(outcome)::BIGINT AS n_retained, round(avg(outcome) * 100, 6) AS success_rate
FROM outcomes""")
def outcome_stats(spark, sf):
    return rounded(outcomes.outcome_totals(D.outcomes(spark, sf)))


@query("campaign_pivot", f"""WITH {D.OUTCOMES}
SELECT intervention_type, count(*) FILTER (outcome = 0) AS churned, count(*) FILTER (outcome = 1) AS retained
FROM outcomes GROUP BY intervention_type""")
def campaign_pivot(spark, sf):
    return outcomes.campaign_results(D.outcomes(spark, sf))


def _decay(spark, sf):
    scores = D.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("customerID"), ((F.col("c_acctbal") + 1000.0) / 11000.0).alias("churn_score"))
    return drift.model_decay(D.outcomes(spark, sf), scores, "customerID", time="timestamp", as_of=D.AS_OF)


_DECAY = f"""{D.OUTCOMES},
recent AS (SELECT * FROM outcomes
  WHERE "timestamp" > TIMESTAMP '{D.AS_OF}' - INTERVAL 30 DAYS AND "timestamp" <= TIMESTAMP '{D.AS_OF}'),
matched AS (SELECT 1 - outcome AS y, (c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS p
  FROM recent JOIN customer ON CAST(c_custkey AS VARCHAR) = customer_id),
decay AS (
  SELECT (SELECT count(*) FROM recent) AS n_outcomes, n_pos + n_neg AS n_scored, roc_auc AS auc,
    (0.85::DOUBLE - roc_auc) / 0.85::DOUBLE AS decay,
    CASE WHEN (0.85::DOUBLE - roc_auc) / 0.85::DOUBLE > 0.05::DOUBLE THEN 1 ELSE 0 END AS alert
  FROM ({_roc("matched")}))"""


@query("model_decay", f"""WITH {_DECAY}
SELECT n_outcomes, n_scored, round(auc, 6) AS auc, round(decay, 6) AS decay, alert FROM decay""")
def model_decay(spark, sf):
    return rounded(_decay(spark, sf))


@query("retrain_trigger", f"""WITH {_PSI}, {_DECAY}
SELECT n AS n_drifted, alert AS decayed, CASE WHEN n > 0 OR alert = 1 THEN 1 ELSE 0 END AS fire
FROM (SELECT count(*) FILTER (psi > 0.2) AS n FROM psi), decay""")
def retrain_trigger(spark, sf):
    return drift.retrain_trigger(_psi(spark, sf), _decay(spark, sf))


_MODELS = f"""{D.GRADED},
long AS (SELECT 'champion' AS model, y, p FROM graded UNION ALL SELECT 'challenger', y, q FROM graded),
roc AS ({_roc("long", by="model")}), pr AS ({_pr("long", by="model")}),
cells AS (SELECT model, {_confusion("0.32::DOUBLE")} FROM long GROUP BY model),
comparison AS (
  SELECT model, roc.roc_auc, pr.pr_auc, tp / (tp + fn)::DOUBLE AS recall, (fn * 1680 + fp * 50)::DOUBLE AS cost
  FROM roc JOIN pr USING (model) JOIN cells USING (model))"""


def _compared(spark, sf):
    rows = D.graded_documents(spark, sf)
    long = rows.select(F.lit("champion").alias("model"), "y", "p").unionByName(
        rows.select(F.lit("challenger").alias("model"), "y", F.col("q").alias("p")))
    return metrics.model_comparison(long, "model", "y", "p", 0.32)


@query("model_comparison", f"""WITH {_MODELS}
SELECT model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(recall, 6) AS recall, cost FROM comparison""")
def model_comparison(spark, sf):
    return rounded(_compared(spark, sf))


@query("promotion_gate", f"""WITH {_MODELS},
c AS (SELECT * FROM comparison WHERE model = 'champion'),
gates AS (
  SELECT n.model, round(n.roc_auc, 6) AS roc_auc, round(n.pr_auc, 6) AS pr_auc, round(n.recall, 6) AS recall, n.cost,
    CASE WHEN n.roc_auc >= c.roc_auc - 0.02 THEN 1 ELSE 0 END AS safety_ok,
    CASE WHEN n.roc_auc >= 0.84 THEN 1 ELSE 0 END AS roc_ok,
    CASE WHEN n.pr_auc >= c.pr_auc * 0.98 THEN 1 ELSE 0 END AS pr_ok,
    CASE WHEN n.recall > 0.8 THEN 1 ELSE 0 END AS recall_ok
  FROM comparison n, c WHERE n.model <> 'champion')
SELECT *, least(safety_ok, roc_ok, pr_ok, recall_ok) AS passes FROM gates""")
def promotion_gate(spark, sf):
    return rounded(metrics.promotion_gate(_compared(spark, sf), "model", "champion"))
