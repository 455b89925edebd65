"""Contracts, cleaning and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from keepwell.functions import features
from keepwell.operators import quality
from keepwell.operators.prepare import distinct_values
from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded
from keepwell.sources import contracts, tables

_DIRTY = D.CUSTOMERS + """,
dirty AS (
  SELECT * EXCLUDE ("Churn", "TotalCharges"),
    CASE WHEN k % 97 = 0 THEN ' ' WHEN k % 89 = 0 THEN 'n/a' ELSE 'number' END AS "TotalCharges",
    CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN 'Maybe' WHEN "Churn" = 1 THEN 'Yes' ELSE 'No' END AS "Churn"
  FROM customers)"""


def _union(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


def _violation_rows() -> list[str]:
    out = []
    for c in contracts.CUSTOMERS.columns:
        name = f'"{c.name}"'
        broken = {"required": f"{name} IS NULL"}
        if c.allowed:
            allowed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in c.allowed)
            broken["enum"] = f"{name} NOT IN ({allowed})"
        if c.minimum is not None:
            broken["minimum"] = f"{name} < {c.minimum}"
        if c.maximum is not None:
            broken["maximum"] = f"{name} > {c.maximum}"
        out += [f"SELECT '{c.name}' AS column_name, '{rule}' AS rule, count(*) FILTER ({condition}) AS n_bad FROM dirty"
                for rule, condition in broken.items()]
    return out


@query("contract_violations", f"WITH {_DIRTY} {_union(_violation_rows())}")
def contract_violations(spark, sf):
    return contracts.violations(D.customers(spark, sf, churn=True, dirty=True), contracts.CUSTOMERS)


_ABSENT = ["SeniorCitizen", "Partner", "Dependents", "PaymentMethod", "Churn"]


@query("contract_missing_columns", f"""WITH {D.CUSTOMERS} {_union(
    f"SELECT '{c}' AS column_name, 'missing' AS rule, count(*) AS n_bad FROM customers" for c in _ABSENT)}""")
def contract_missing_columns(spark, sf):
    """Customers as they come without the account's columns and the label."""
    return contracts.absent_columns(D.customers(spark, sf, accounts=False), contracts.CUSTOMERS)


@query("coerce_numeric", f"""WITH {D.CUSTOMERS}
SELECT "customerID", round(CASE WHEN k % 97 = 0 OR k % 89 = 0 THEN "TotalCharges" ELSE o_totalprice END, 6)
  AS "TotalCharges" FROM customers""")
def coerce_numeric(spark, sf):
    return rounded(quality.coerce_totals(D.customers(spark, sf, dirty=True, accounts=False)).select("customerID", "TotalCharges"))


@query("dedup_keep_first", """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice, o_orderpriority, n - 1 AS n_dups FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place,
    count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
WHERE place = 1""")
def dedup_keep_first(spark, sf):
    return quality.keep_first(D.table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("label_filter", f"""WITH {_DIRTY}
SELECT count(*) FILTER ("Churn" IN ('Yes', 'No')) AS kept,
  count(*) FILTER ("Churn" IS NULL OR "Churn" NOT IN ('Yes', 'No')) AS dropped FROM dirty""")
def label_filter(spark, sf):
    return quality.label_report(D.customers(spark, sf, churn=True, dirty=True, accounts=False), "Churn")


@query("labelled_customers", f"""WITH {_DIRTY}
SELECT "customerID", "Churn" FROM dirty WHERE "Churn" IN ('Yes', 'No')""")
def labelled_customers(spark, sf):
    return quality.keep_labelled(D.customers(spark, sf, churn=True, dirty=True, accounts=False), "Churn").select("customerID", "Churn")


_RANGES = {"l_quantity": (5.0, 45.0), "l_discount": (0.02, 0.08)}


@query("range_flags", _union([
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < {lo}::DOUBLE OR {c} > {hi}::DOUBLE) AS n_out FROM lineitem"
    for c, (lo, hi) in _RANGES.items()]))
def range_flags(spark, sf):
    return quality.range_report(D.table(spark, sf, "lineitem"), _RANGES)


@query("range_flagged_customers", f"""WITH {D.CUSTOMERS}
SELECT "customerID", tenure, CASE WHEN tenure < 0 OR tenure > 72 THEN 1 ELSE 0 END AS tenure_out_of_range,
  CASE WHEN "MonthlyCharges" < 0 OR "MonthlyCharges" > 200 THEN 1 ELSE 0 END AS "MonthlyCharges_out_of_range"
FROM customers""")
def range_flagged_customers(spark, sf):
    flagged = quality.with_range_flags(D.customers(spark, sf, accounts=False), {"tenure": (0, 72), "MonthlyCharges": (0, 200)})
    return flagged.select("customerID", "tenure", *[
        F.col(f"{c}_out_of_range").cast("int").alias(f"{c}_out_of_range") for c in ("tenure", "MonthlyCharges")])


@query("key_overlap", """WITH l AS (SELECT DISTINCT c_custkey AS k FROM customer),
r AS (SELECT DISTINCT user_id AS k FROM events)
SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right,
  (SELECT count(*) FROM l JOIN r USING (k)) AS n_both,
  round((SELECT count(*) FROM l JOIN r USING (k)) / (SELECT count(*) FROM l)::DOUBLE, 6) AS rate,
  CASE WHEN (SELECT count(*) FROM l JOIN r USING (k)) / (SELECT count(*) FROM l)::DOUBLE < 0.1::DOUBLE
    THEN 1 ELSE 0 END AS warn""")
def key_overlap(spark, sf):
    found = quality.key_overlap(D.table(spark, sf, "customer"), D.table(spark, sf, "events"), "c_custkey", "user_id")
    return rounded(found.withColumn("warn", F.col("warn").cast("int")))


_CHECKED = [c.name for c in contracts.CUSTOMERS.columns]


@query("null_rate", f"WITH {_DIRTY} " + _union([
    f"""SELECT '{c}' AS column_name, round(avg(CASE WHEN "{c}" IS NULL THEN 1.0 ELSE 0.0 END), 6) AS value,
    CASE WHEN avg(CASE WHEN "{c}" IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 THEN 1 ELSE 0 END AS failed FROM dirty"""
    for c in _CHECKED]))
def null_rate(spark, sf):
    return rounded(quality.null_rates(D.customers(spark, sf, churn=True, dirty=True).select(*_CHECKED)))


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("zero_variance", _union([
    f"""SELECT '{c}' AS column_name, round(stddev_samp({c}::DOUBLE), 4) AS value,
    CASE WHEN min({c}) = max({c}) THEN 1 ELSE 0 END AS failed FROM (SELECT *, 7 AS always FROM lineitem)"""
    for c in [*_LINE, "always"]]))
def zero_variance(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(*_LINE).withColumn("always", F.lit(7))
    return rounded(quality.zero_variance(rows), 4)


_LEAK_SOURCE = """(SELECT *, 7 AS always, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  CASE WHEN l_returnflag = 'R' THEN 3.0::DOUBLE ELSE 0.5::DOUBLE END AS refund FROM lineitem)"""


@query("target_leakage", "SELECT column_name, round(r, 6) AS value, CASE WHEN r > 0.95::DOUBLE THEN 1 ELSE 0 END AS failed FROM (" + _union([
    f"""SELECT '{c}' AS column_name,
    abs(covar_samp({c}::DOUBLE, y::DOUBLE) / nullif(stddev_samp({c}::DOUBLE) * stddev_samp(y::DOUBLE), 0)) AS r FROM {_LEAK_SOURCE}"""
    for c in [*_LINE, "always", "refund"]]) + ")")
def target_leakage(spark, sf):
    returned = F.col("l_returnflag") == "R"
    rows = D.table(spark, sf, "lineitem").select(
        *_LINE, F.lit(7).alias("always"), F.when(returned, 3.0).otherwise(0.5).alias("refund"),
        returned.cast("int").alias("y"))
    return rounded(quality.target_leakage(rows, "y"))


@query("quality_report", f"""WITH {D.CUSTOMERS},
t AS (SELECT "Contract", tenure, "MonthlyCharges", 1 AS flat, "Churn" * 2 AS echo, "Churn" FROM customers)
SELECT 'null_rate' AS check_name, sum(f)::BIGINT AS n_failed, CASE WHEN sum(f) > 0 THEN 1 ELSE 0 END AS failed FROM (
  SELECT unnest([avg(("Contract" IS NULL)::INT) > 0.05, avg((tenure IS NULL)::INT) > 0.05])::INT AS f FROM t)
UNION ALL SELECT 'zero_variance', sum(f)::BIGINT, CASE WHEN sum(f) > 0 THEN 1 ELSE 0 END FROM (
  SELECT unnest([stddev_samp(tenure) = 0, stddev_samp("MonthlyCharges") = 0, stddev_samp(flat) = 0,
    stddev_samp("Churn") = 0])::INT AS f FROM t)
UNION ALL SELECT 'target_leakage', sum(f)::BIGINT, CASE WHEN sum(f) > 0 THEN 1 ELSE 0 END FROM (
  SELECT unnest([abs(corr(tenure, "Churn")) > 0.95, abs(corr("MonthlyCharges", "Churn")) > 0.95,
    abs(corr(echo, "Churn")) > 0.95])::INT AS f FROM t)""")
def quality_report(spark, sf):
    rows = D.customers(spark, sf, churn=True, accounts=False).select(
        "Contract", "tenure", "MonthlyCharges", F.lit(1).alias("flat"),
        (F.col("Churn") * 2).alias("echo"), "Churn")
    return quality.quality_report(rows, "Churn")


@query("manifest_summary", f"""WITH {D.CUSTOMERS},
dated AS (SELECT '2024-03-01' AS snapshot_date, tenure, "Churn" AS churn, tenure AS extra FROM customers
  UNION ALL SELECT '2024-03-02', tenure, "Churn", "Churn" * 2 FROM customers)
SELECT snapshot_date, 'v1.0' AS pipeline_version, count(*) AS row_count,
  CASE WHEN coalesce(stddev_samp(tenure) = 0 OR stddev_samp(extra) = 0 OR abs(corr(extra, churn)) > 0.95
    OR avg((tenure IS NULL)::INT) > 0.05, false) THEN 'FAILED' ELSE 'PASSED' END AS status,
  'null_rate,zero_variance,target_leakage' AS checks_run FROM dated GROUP BY snapshot_date""")
def manifest_summary(spark, sf):
    """The record of a snapshot that passes, and of one whose extra column tells the label."""
    rows = D.customers(spark, sf, churn=True, accounts=False).select("tenure", F.col("Churn").alias("churn"))
    made = {"2024-03-01": rows.withColumn("extra", F.col("tenure")), "2024-03-02": rows.withColumn("extra", F.col("churn") * 2)}
    row = reduce(DataFrame.unionByName, [
        tables.manifest(t, day, {"customers": "orders"}, quality.verdict(quality.quality_report(t, "churn")))
        for day, t in made.items()])
    return row.select("snapshot_date", "pipeline_version", "row_count", "status",
                      F.array_join("checks_run", ",").alias("checks_run"))


_LABELS = ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]
_ADD_ONS = ["MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
            "StreamingTV", "StreamingMovies"]


@query("encode_features", f"""WITH {D.CUSTOMERS} SELECT "customerID",
  {", ".join(f'''CASE "{c}" WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS "{c}"''' for c in _LABELS)},
  {", ".join(f'''CASE WHEN "{c}" LIKE 'No %' THEN 'No' ELSE "{c}" END AS "{c}"''' for c in _ADD_ONS)},
  CASE "Contract" WHEN 'Month-to-month' THEN 0 WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 END
    AS contract_type_encoded FROM customers""")
def encode_features(spark, sf):
    return features.encode_customers(D.customers(spark, sf)).select(
        "customerID", *_LABELS, *_ADD_ONS, "contract_type_encoded")


@query("billing_features", f"""WITH {D.CUSTOMERS}
SELECT "customerID", round("TotalCharges" / greatest(tenure, 1)::DOUBLE, 6) AS charges_per_tenure_month,
  CASE WHEN "Contract" = 'Month-to-month' AND tenure < 12 THEN 1 ELSE 0 END AS is_high_risk_contract FROM customers""")
def billing_features(spark, sf):
    return rounded(features.billing_features(D.customers(spark, sf, accounts=False)).select(
        "customerID", "charges_per_tenure_month", "is_high_risk_contract"))


@query("service_bundle_size", f"""WITH {D.CUSTOMERS}
SELECT "customerID", len(list_filter(["PhoneService", {", ".join(f'"{c}"' for c in _ADD_ONS)}], lambda a: a = 'Yes'))::INT
  AS service_bundle_size FROM customers""")
def service_bundle_size(spark, sf):
    return D.customers(spark, sf, accounts=False).select("customerID", features.bundle_size().alias("service_bundle_size"))


@query("tenure_band", f"""WITH {D.CUSTOMERS}
SELECT CASE WHEN tenure < 0 OR tenure > 73 THEN NULL WHEN tenure <= 12 THEN '<12 months'
    WHEN tenure <= 24 THEN '12-24 months' WHEN tenure <= 48 THEN '24-48 months' ELSE '>48 months' END AS tenure_band,
  count(*) AS n FROM customers GROUP BY 1""")
def tenure_band(spark, sf):
    return D.customers(spark, sf, accounts=False).groupBy(features.stored_tenure_band(F.col("tenure")).alias("tenure_band")).agg(
        F.count("*").alias("n"))


@query("distinct_segments", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct_segments(spark, sf):
    return distinct_values(D.table(spark, sf, "customer"), "c_mktsegment")
