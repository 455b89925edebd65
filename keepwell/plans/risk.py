"""Scorecard, risk tables and canned questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import features, render, scoring, values
from keepwell.operators import explain, reports, tickets
from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded
from keepwell.session import settle

_MONEY = """'$' || printf('%.2f', "MonthlyCharges")"""
_PERCENT = """printf('%.2f', p * 100.0::DOUBLE) || '%'"""


@query("risk_scorecard", f"""WITH {D.SCORED}
SELECT "customerID", round(p, 6) AS churn_score,
  round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, abs(p - 0.32::DOUBLE) * 2.0::DOUBLE)), 6) AS confidence,
  CASE WHEN p >= 0.32::DOUBLE THEN 'High Risk' ELSE 'Low Risk' END AS risk_level,
  CASE WHEN p >= 0.32::DOUBLE THEN 1 ELSE 0 END AS action_needed
FROM scored""")
def risk_scorecard(spark, sf):
    return rounded(D.scored_customers(spark, sf).select(
        "customerID", "churn_score", "confidence", "risk_level", "action_needed"))


@query("risk_table", f"""WITH {D.SCORED}
SELECT "customerID", "Contract", tenure, {_MONEY} AS "MonthlyCharges", {_PERCENT} AS churn_score
FROM scored WHERE p >= 0.32::DOUBLE AND tenure BETWEEN 12 AND 24""")
def risk_table(spark, sf):
    rows = reports.risk_filter(D.scored_customers(spark, sf), 0.32, segment="12-24 months")
    return reports.risk_table(rows)


@query("risk_table_by_contract", f"""WITH {D.SCORED}
SELECT "customerID", "Contract", tenure, {_MONEY} AS "MonthlyCharges", {_PERCENT} AS churn_score
FROM scored WHERE p >= 0.4::DOUBLE AND "Contract" = 'Month-to-month'""")
def risk_table_by_contract(spark, sf):
    return reports.risk_table(reports.risk_filter(D.scored_customers(spark, sf), 0.4, contract="Month-to-month"))


@query("risk_kpis", f"""WITH {D.SCORED}
SELECT count(*) FILTER (p > 0.70::DOUBLE) AS n_high, round(avg(p), 6) AS avg_score FROM scored""")
def risk_kpis(spark, sf):
    return rounded(reports.risk_figures(D.scored_customers(spark, sf)))


@query("price_sensitive", f"""WITH {D.SCORED}
SELECT "customerID", round("MonthlyCharges", 6) AS "MonthlyCharges", round(p, 6) AS churn_score
FROM scored WHERE p >= 0.32::DOUBLE AND "MonthlyCharges" >= 80""")
def price_sensitive(spark, sf):
    return rounded(reports.price_sensitive(D.scored_customers(spark, sf)).select(
        "customerID", "MonthlyCharges", "churn_score"))


@query("price_sensitive_answer", f"""WITH {D.SCORED},
hits AS (SELECT * FROM scored WHERE p >= 0.32::DOUBLE AND "MonthlyCharges" >= 80)
SELECT "customerID", round(p, 6) AS churn_score, (SELECT count(*) FROM hits) AS n_found
FROM hits ORDER BY p DESC, "customerID" LIMIT 3""")
def price_sensitive_answer(spark, sf):
    found = reports.price_sensitive(D.scored_customers(spark, sf)).select("customerID", "churn_score")
    return rounded(reports.first_answers(found))


_FLAGS = D.text_features_sql("(SELECT * FROM conversations WHERE role = 'user')", "conv_id")


@query("escalated_at_risk", f"""WITH {D.SCORED}, {_FLAGS},
flags AS (SELECT conv_id, max(escalation_flag) AS escalation_flag FROM featured GROUP BY conv_id)
SELECT "customerID", round(p, 6) AS churn_score FROM scored JOIN flags ON account_id = conv_id
WHERE escalation_flag = 1 AND p >= 0.32::DOUBLE""")
def escalated_at_risk(spark, sf):
    rolled = tickets.rollup(tickets.with_text_features(D.tickets(spark, sf), lexicon=D.LEXICON))
    flags = rolled.select(F.col("customerID").cast("long").alias("account_id"),
                          F.col("ticket_escalation_flag").alias("escalation_flag"))
    rows = D.scored_customers(spark, sf).join(flags, "account_id", "left")
    return rounded(reports.escalated_at_risk(rows).select("customerID", "churn_score"))


_PARTS = D.SCORED + """,
parts AS (
  SELECT "customerID", 'contract_type_encoded' AS feature,
    CASE WHEN "Contract" = 'Month-to-month' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS v FROM scored
  UNION ALL SELECT "customerID", 'tenure', CASE WHEN tenure <= 6 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END FROM scored
  UNION ALL SELECT "customerID", 'InternetService_Fiber optic',
    CASE WHEN "InternetService" = 'Fiber optic' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END FROM scored),
contributions AS (
  SELECT "customerID", feature, round(v - avg(v) OVER (PARTITION BY feature), 9) AS value FROM parts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY "customerID" ORDER BY abs(value) DESC, feature) AS place
  FROM contributions),
drivers AS (
  SELECT "customerID", max(feature) FILTER (place = 1) AS d1, max(feature) FILTER (place = 2) AS d2,
    max(feature) FILTER (place = 3) AS d3 FROM placed GROUP BY "customerID")"""


def _with_drivers(spark, sf):
    rows = explain.additive_contributions(D.scored_customers(spark, sf), scoring.points())
    return rows.withColumn("top_drivers", explain.top_drivers(F.col("contributions")))


@query("top_drivers", f'WITH {_PARTS} SELECT "customerID", d1, d2, d3 FROM drivers')
def top_drivers(spark, sf):
    return _with_drivers(spark, sf).select(
        "customerID", *[F.col("top_drivers")[i].alias(f"d{i + 1}") for i in range(3)])


@query("top_two_drivers", f"""WITH {_PARTS}
SELECT "customerID", d1 || ',' || d2 AS drivers FROM drivers""")
def top_two_drivers(spark, sf):
    """The cut itself: two of three features are named."""
    rows = explain.additive_contributions(D.scored_customers(spark, sf), scoring.points())
    return rows.select("customerID", F.array_join(explain.top_drivers(F.col("contributions"), 2), ",").alias("drivers"))


@query("contract_names", f"""WITH {D.CUSTOMERS}
SELECT "customerID", CASE WHEN "Contract" IN ('Month-to-month', 'One year', 'Two year') THEN "Contract" ELSE 'Unknown' END
  AS "Contract" FROM customers""")
def contract_names(spark, sf):
    coded = features.encode_customers(D.customers(spark, sf, accounts=False)).drop("Contract")
    return reports.with_contract_name(coded).select("customerID", "Contract")


@query("scores_joined", f"""WITH {D.SCORED}
SELECT "customerID", tenure, round(p, 6) AS churn_score, CASE WHEN p >= 0.32::DOUBLE THEN 'High Risk' ELSE 'Low Risk' END
  AS risk_level FROM scored""")
def scores_joined(spark, sf):
    """Scores stored as a table of their own, then joined to the customers they belong to."""
    scores = settle(D.scored_customers(spark, sf).select("customerID", "churn_score", "risk_level"), "scores")
    return rounded(D.customers(spark, sf, accounts=False).select("customerID", "tenure").join(scores, "customerID"))


@query("global_importance", f"""WITH {_PARTS}
SELECT feature, round(avg(abs(value)), 6) AS mean_abs FROM contributions GROUP BY feature""")
def global_importance(spark, sf):
    return rounded(explain.global_importance(_with_drivers(spark, sf)))


_REPEATS, _SEED, _RINGS = 5, "42", 1024


@query("permutation_importance", f"""WITH {D.CUSTOMERS},
dealt AS (SELECT *, md5('{_SEED}:' || "customerID") AS word FROM customers),
sliced AS (SELECT *, CAST('0x' || substr(word, 9, 8) AS BIGINT) % {_RINGS} AS slice FROM dealt),
ring AS (
  SELECT *, row_number() OVER (PARTITION BY slice ORDER BY substr(word, 1, 15), "customerID") AS place,
    count(*) OVER (PARTITION BY slice) AS size FROM sliced),
pairs AS (
  SELECT r, a."Churn" AS y, a."Contract" AS c, a.tenure AS t, a."InternetService" AS i, a."MonthlyCharges" AS m,
    b."Contract" AS c2, b.tenure AS t2, b."InternetService" AS i2
  FROM (SELECT * FROM ring, range(1, {_REPEATS + 1}) AS t(r)) a
  JOIN ring b ON b.slice = a.slice AND b.place = (a.place + a.r - 1) % a.size + 1),
answers AS (
  SELECT r, y, unnest(['base', 'contract_type_encoded', 'tenure', 'InternetService_Fiber optic', 'MonthlyCharges'])
      AS feature,
    unnest([c, c2, c, c, c]) AS c, unnest([t, t, t2, t, t]) AS t, unnest([i, i, i, i2, i]) AS i FROM pairs),
accuracy AS (
  SELECT r, feature, avg(CASE WHEN (CASE WHEN least(0.96::DOUBLE, greatest(0.04::DOUBLE, 0.15::DOUBLE
    + CASE WHEN c = 'Month-to-month' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN t <= 6 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN i = 'Fiber optic' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END)) >= 0.5::DOUBLE THEN 1 ELSE 0 END) = y
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
  FROM answers GROUP BY r, feature),
losses AS (
  SELECT a.feature, b.acc - a.acc AS loss FROM accuracy a JOIN accuracy b ON a.r = b.r AND b.feature = 'base'
  WHERE a.feature <> 'base')
SELECT feature, round(avg(loss), 6) AS importance_mean, round(stddev_pop(loss), 6) AS importance_std
FROM losses GROUP BY feature""")
def permutation_importance(spark, sf):
    def predict(inputs):
        return (scoring.scorecard({c: inputs[c] for c in ("Contract", "tenure", "InternetService")}) >= 0.5).cast("int")

    columns = {"contract_type_encoded": "Contract", "tenure": "tenure",
               "InternetService_Fiber optic": "InternetService", "MonthlyCharges": "MonthlyCharges"}
    rows = D.customers(spark, sf, churn=True, accounts=False)
    return rounded(explain.permutation_importance(rows, "customerID", "Churn", columns, predict,
                                                  _REPEATS, _SEED, _RINGS))


_PHRASE = """CASE WHEN contains(lower(d), 'contract') THEN CASE code WHEN 0 THEN ' month-to-month contract'
      WHEN 1 THEN ' one-year contract' ELSE ' two-year contract' END
    WHEN contains(lower(d), 'tenure') THEN ' tenure ' || tenure || ' months' ELSE '' END"""


@query("query_text", f"""WITH {_PARTS}, {_FLAGS},
flags AS (SELECT conv_id, max(escalation_flag) AS e, avg(sentiment_score) AS s FROM featured GROUP BY conv_id),
facts AS (
  SELECT "customerID", [
    CASE "Contract" WHEN 'One year' THEN 'one-year contract' WHEN 'Two year' THEN 'two-year contract'
      ELSE 'month-to-month contract' END,
    'tenure ' || tenure || ' months', 'monthly charges ' || {_MONEY},
    CASE WHEN "TechSupport" = 'Yes' THEN 'has tech support' ELSE 'no tech support' END,
    CASE WHEN "OnlineSecurity" = 'Yes' THEN 'has online security' ELSE 'no online security' END,
    CASE WHEN e = 1 THEN 'escalated support ticket' ELSE 'no escalation' END,
    CASE WHEN round(coalesce(s, 0), 6) < 0 THEN 'negative ticket sentiment ' ELSE 'neutral sentiment ' END
      || printf('%.2f', round(coalesce(s, 0.0::DOUBLE), 6))] AS said
  FROM scored LEFT JOIN flags ON account_id = conv_id)
SELECT "customerID", first_driver, 'customer ' || said[first_driver] || ' ' || said[first_driver % 7 + 1] AS query_text
FROM facts, range(1, 8) AS t(first_driver)""")
def query_text(spark, sf):
    """Every phrase for every customer: each feature leads once and the next one follows."""
    names = ["contract_type_encoded", "tenure", "MonthlyCharges", "TechSupport", "OnlineSecurity",
             "ticket_escalation_flag", "ticket_sentiment_score"]
    rolled = tickets.rollup(tickets.with_text_features(D.tickets(spark, sf), lexicon=D.LEXICON)).select(
        F.col("customerID").cast("long").alias("account_id"), F.col("ticket_escalation_flag").alias("escalation_flag"),
        F.round("ticket_sentiment_score", 6).alias("sentiment_score"))
    rows = D.scored_customers(spark, sf).join(rolled, "account_id", "left").na.fill(0, ["escalation_flag"]).withColumns({
        "contract_type_encoded": features.coded(F.col("Contract"), values.CONTRACT_CODES),
        "first_driver": F.explode(F.sequence(F.lit(1), F.lit(len(names))))})
    pairs = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in zip(names, [*names[1:], names[0]])])
    asked = rows.withColumn("top_drivers", F.get(pairs, F.col("first_driver") - 1))
    return render.with_query_text(asked).select("customerID", F.col("first_driver").cast("long").alias("first_driver"), "query_text")
