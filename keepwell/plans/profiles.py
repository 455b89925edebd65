"""Customer profiles: enrichment, imputation, defaults, snapshot, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import features, values as V
from keepwell.operators import events, impute
from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded
from keepwell.session import scratch_path
from keepwell.sources import snapshots


def _enriched(spark, sf):
    rows = D.customers(spark, sf, accounts=False).withColumn("account", F.col("account_id").cast("string"))
    return impute.enrich_from_bank(rows, D.bank(spark, sf), key="account")


@query("customer_enrich", f"""WITH {D.CUSTOMERS}, {D.BANK}
SELECT customers."customerID", "CreditScore", round("Balance", 6) AS "Balance", "NumOfProducts",
  round("EstimatedSalary", 6) AS "EstimatedSalary", CASE WHEN "CreditScore" IS NULL THEN 0 ELSE 1 END AS matched
FROM customers LEFT JOIN bank ON CAST(account_id AS VARCHAR) = bank."CustomerId" """)
def customer_enrich(spark, sf):
    return rounded(_enriched(spark, sf).select(
        "customerID", *V.BANK_COLUMNS, F.col("CreditScore").isNotNull().cast("int").alias("matched")))


_MEDIAN = """(SELECT quantile_cont({c}::DOUBLE, 0.5) FROM bank)"""


@query("impute_median", f"""WITH {D.CUSTOMERS}, {D.BANK}
SELECT customers."customerID",
  coalesce("CreditScore"::DOUBLE, round_even({_MEDIAN.format(c='"CreditScore"')}, 0)) AS "CreditScore",
  round(coalesce("Balance", {_MEDIAN.format(c='"Balance"')}), 6) AS "Balance",
  coalesce("NumOfProducts"::DOUBLE, round_even({_MEDIAN.format(c='"NumOfProducts"')}, 0)) AS "NumOfProducts",
  round(coalesce("EstimatedSalary", {_MEDIAN.format(c='"EstimatedSalary"')}), 6) AS "EstimatedSalary"
FROM customers LEFT JOIN bank ON CAST(account_id AS VARCHAR) = bank."CustomerId" """)
def impute_median(spark, sf):
    stats = impute.column_statistics(D.bank(spark, sf), V.BANK_COLUMNS)
    filled = impute.impute(_enriched(spark, sf), stats, V.BANK_COLUMNS)
    return rounded(filled.select("customerID", *V.BANK_COLUMNS))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_statistics", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS deviation,
    round(min({c}), 4) AS lowest, round(max({c}), 4) AS highest FROM lineitem""" for c in _MEASURES))
def column_statistics(spark, sf):
    return rounded(impute.column_statistics(D.table(spark, sf, "lineitem"), _MEASURES), 4)


_DEFAULTED = ["tenure", "MonthlyCharges", "CreditScore", "SeniorCitizen", "Partner", "contract_type_encoded",
              "logins_7d_rolling_avg", "days_since_last_login", "charges_per_tenure_month",
              "is_high_risk_contract", "competitor_news_volume_7d", "not_a_feature"]


@query("score_defaults", f"""WITH {D.CUSTOMERS},
snapshot AS (SELECT * FROM customers WHERE "Contract" IS NOT NULL)
SELECT CAST(o_orderkey AS VARCHAR) AS "customerID",
  coalesce(tenure, 0)::DOUBLE AS tenure, round(coalesce("MonthlyCharges", 0), 6)::DOUBLE AS "MonthlyCharges",
  650.0::DOUBLE AS "CreditScore", coalesce("SeniorCitizen", 0)::DOUBLE AS "SeniorCitizen",
  CASE WHEN "Partner" = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Partner",
  CASE "Contract" WHEN 'One year' THEN 1.0::DOUBLE WHEN 'Two year' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
    AS contract_type_encoded,
  0.5::DOUBLE AS logins_7d_rolling_avg, 5.0::DOUBLE AS days_since_last_login,
  round(coalesce("TotalCharges", 0) / greatest(coalesce(tenure, 0), 1)::DOUBLE, 6)
    AS charges_per_tenure_month,
  CASE WHEN "Contract" = 'Month-to-month' AND tenure < 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_high_risk_contract,
  15.0::DOUBLE AS competitor_news_volume_7d, 0.0::DOUBLE AS not_a_feature
FROM orders LEFT JOIN snapshot ON k = o_orderkey""")
def score_defaults(spark, sf):
    requests = D.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("customerID"))
    snapshot = D.customers(spark, sf).where("Contract IS NOT NULL")
    known = features.model_inputs(requests.join(snapshot, "customerID", "left"))
    ready = features.in_contract_order(features.with_defaults(known), _DEFAULTED, ["customerID"])
    return rounded(ready)


_BUCKETS = 8
_GROUPS = {
    "who": ["customerID", "gender", "SeniorCitizen", "tenure"],
    "services": ["customerID", "TechSupport", "OnlineSecurity", "tenure"],
    "bills": ["customerID", "MonthlyCharges", "TotalCharges", "PaymentMethod"],
    "terms": ["customerID", "Contract", "MonthlyCharges"],
    "line": ["customerID", "InternetService"],
}


@query("snapshot_join", f"""WITH {D.CUSTOMERS}
SELECT "customerID", gender, "SeniorCitizen", tenure, "TechSupport", "OnlineSecurity",
  round("MonthlyCharges", 6) AS "MonthlyCharges", round("TotalCharges", 6) AS "TotalCharges", "PaymentMethod",
  "Contract", "InternetService" FROM customers""")
def snapshot_join(spark, sf):
    """Five groups written clustered by the key and joined again without a shuffle."""
    root = scratch_path(spark, "clustered")
    snapshots.write_groups(D.customers(spark, sf), root, "2024-03-01", _GROUPS, buckets=_BUCKETS)
    return rounded(snapshots.read_snapshot(spark, root, "2024-03-01", list(_GROUPS)))


@query("price_competitiveness", """
SELECT p_partkey, round(cheapest / p_retailprice, 6) AS price_competitiveness_ratio
FROM part JOIN (SELECT p_type, min(p_retailprice) AS cheapest FROM part GROUP BY p_type) USING (p_type)""")
def price_competitiveness(spark, sf):
    parts = D.table(spark, sf, "part")
    found = events.price_competitiveness(parts, parts, ["p_type"], "p_retailprice", "p_retailprice")
    return rounded(found.select("p_partkey", "price_competitiveness_ratio"))
