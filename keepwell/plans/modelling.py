"""Splits, scaling, one-hot columns, the model vector and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import values as V
from keepwell.operators import outcomes, prepare, sampling
from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded
from keepwell.session import settle

_RANK = """row_number() OVER (PARTITION BY "Churn" ORDER BY md5('{seed}:' || "customerID"), "customerID")"""
_SPLIT = f"""{D.CUSTOMERS},
placed AS (SELECT *, {_RANK.format(seed="42")} AS place, count(*) OVER (PARTITION BY "Churn") AS n FROM customers),
split AS (SELECT *, CASE WHEN place <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM placed)"""


_OF_ACCOUNT = {"SeniorCitizen", "Partner", "Dependents", "PaymentMethod"}


def _snapshot(spark, sf, *columns: str):
    """The customers as a written table, as training reads them: the columns it needs."""
    rows = D.customers(spark, sf, churn=True, accounts=bool(_OF_ACCOUNT & {*columns}))
    return settle(rows.select("customerID", "Churn", *columns), "snapshot")


def _split(spark, sf, *columns: str):
    return sampling.stratified_split(_snapshot(spark, sf, *columns), "Churn", "customerID")


@query("stratified_split", f'WITH {_SPLIT} SELECT "customerID", "Churn", split FROM split')
def stratified_split(spark, sf):
    return _split(spark, sf).select("customerID", "Churn", "split")


@query("stratified_folds", f"""WITH {D.CUSTOMERS},
placed AS (SELECT *, {_RANK.format(seed="42:fold")} AS place, count(*) OVER (PARTITION BY "Churn") AS n FROM customers)
SELECT "customerID", "Churn", CASE WHEN place <= ceil(n / 3.0::DOUBLE) THEN 0 WHEN place <= ceil(n * 2 / 3.0::DOUBLE)
  THEN 1 ELSE 2 END AS fold FROM placed""")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(_snapshot(spark, sf), "Churn", "customerID").select("customerID", "Churn", "fold")


_SCALED = ["tenure", "MonthlyCharges", "TotalCharges"]


def _fitted(c: str) -> str:
    return f"""(SELECT avg("{c}"::DOUBLE) AS m, stddev_pop("{c}"::DOUBLE) AS s FROM split WHERE split = 'train')"""


@query("scaler_fit", f"WITH {_SPLIT} " + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(m, 6) AS mean, round(s, 6) AS deviation FROM {_fitted(c)}" for c in _SCALED))
def scaler_fit(spark, sf):
    return rounded(prepare.fit_scaler(_split(spark, sf, *_SCALED).where("split = 'train'"), _SCALED))


@query("standard_scale", f"""WITH {_SPLIT}
SELECT "customerID", split, {", ".join(
    f'round(("{c}" - (SELECT m FROM {_fitted(c)})) / (SELECT s FROM {_fitted(c)}), 6) AS "{c}"' for c in _SCALED)}
FROM split""")
def standard_scale(spark, sf):
    rows = _split(spark, sf, *_SCALED)
    scaler = prepare.fit_scaler(rows.where("split = 'train'"), _SCALED)
    return rounded(prepare.scale(rows, scaler).select("customerID", "split", *_SCALED))


@query("one_hot", f"""WITH {D.CUSTOMERS} SELECT "customerID", {", ".join(
    f'''CASE WHEN "{c}" = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "{c}_{v}"'''
    for c, vs in V.CATEGORY_VALUES.items() for v in vs)} FROM customers""")
def one_hot(spark, sf):
    return prepare.one_hot(D.customers(spark, sf)).select("customerID", *[f"`{n}`" for n in V.one_hot_names()])


def _cell(name: str) -> str:
    column, _, value = name.partition("_")
    if name in _SCALED:
        return f'("{name}" - (SELECT m FROM {_fitted(name)})) / (SELECT s FROM {_fitted(name)})'
    if column in V.CATEGORY_VALUES and value:
        return f"""CASE WHEN "{column}" = '{value}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""
    if name in ("Partner", "Dependents", "PaperlessBilling", "TechSupport", "OnlineSecurity"):
        return f"""CASE WHEN "{name}" = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""
    return {
        "SeniorCitizen": '"SeniorCitizen"::DOUBLE',
        "contract_type_encoded":
            """CASE "Contract" WHEN 'One year' THEN 1.0::DOUBLE WHEN 'Two year' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END""",
        "service_bundle_size": f"""len(list_filter([{", ".join(f'"{c}"' for c in V.BUNDLE_COLUMNS)}],
            lambda a: a = 'Yes'))::DOUBLE""",
        "charges_per_tenure_month": '"TotalCharges" / greatest(tenure, 1)::DOUBLE',
        "is_high_risk_contract":
            """CASE WHEN "Contract" = 'Month-to-month' AND tenure < 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END""",
    }.get(name, "0.0::DOUBLE")


_INPUTS = sorted({*_SCALED, *V.CATEGORY_VALUES, *V.BUNDLE_COLUMNS, "Contract", "Partner", "Dependents", "PaperlessBilling",
                  "TechSupport", "OnlineSecurity", "SeniorCitizen"} - {"customerID", "Churn"})


@query("feature_matrix", f"""WITH {_SPLIT} SELECT "customerID", {", ".join(
    f"round({_cell(n)}, 6) AS x{i:02d}" for i, n in enumerate(V.model_columns()))} FROM split""")
def feature_matrix(spark, sf):
    rows = _split(spark, sf, *_INPUTS)
    scaler = prepare.fit_scaler(rows.where("split = 'train'"), _SCALED)
    return prepare.model_matrix(rows, scaler).select("customerID", *[
        F.round(F.col("features")[i], 6).alias(f"x{i:02d}") for i in range(len(V.model_columns()))])


def _hex(word: str) -> str:
    return f"CAST('0x' || substr({word}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("oversample", f"""WITH {D.CUSTOMERS},
counts AS (SELECT "Churn" AS y, count(*) AS n FROM customers GROUP BY 1),
side AS (SELECT (SELECT y FROM counts ORDER BY n, y LIMIT 1) AS y, (SELECT max(n) - min(n) FROM counts) AS missing,
  (SELECT min(n) FROM counts) AS size),
rare AS (
  SELECT "customerID" AS id, tenure / 80.0::DOUBLE AS a, "MonthlyCharges" / 100.0::DOUBLE AS b,
    "SeniorCitizen"::DOUBLE AS c, missing // size AS every, missing % size AS rest
  FROM customers, side WHERE "Churn" = side.y),
bases AS (
  SELECT * FROM (SELECT *, every + CASE WHEN row_number() OVER (ORDER BY md5('42:base:' || id), id) <= rest
    THEN 1 ELSE 0 END AS copies FROM rare) WHERE copies > 0),
near AS (
  SELECT * FROM (
    SELECT x.id, y.id AS other, row_number() OVER (PARTITION BY x.id ORDER BY
      round((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c), 6), y.id) AS place
    FROM bases x, rare y WHERE x.id <> y.id)
  WHERE place <= 5),
sized AS (SELECT id, max(place) AS k FROM near GROUP BY id),
drawn AS (
  SELECT id, copy, floor({_hex("md5('42:pick:' || id || ':' || copy)")} * k)::INT + 1 AS pick,
    {_hex("md5('42:step:' || id || ':' || copy)")} AS step
  FROM (SELECT id, k, unnest(range(1, copies + 1)) AS copy FROM bases JOIN sized USING (id)))
SELECT 'new:' || d.id || ':' || d.copy AS synthetic_id, d.id AS base_id, other AS neighbour_id,
  (SELECT y FROM side) AS "Churn", round(p.a + step * (q.a - p.a), 6) AS a,
  round(p.b + step * (q.b - p.b), 6) AS b, round(p.c + step * (q.c - p.c), 6) AS c
FROM drawn d JOIN near n ON n.id = d.id AND n.place = d.pick JOIN rare p ON p.id = d.id JOIN rare q ON q.id = other""")
def oversample(spark, sf):
    rows = D.customers(spark, sf, churn=True).select("customerID", "Churn", F.array(
        F.col("tenure") / 80.0, F.col("MonthlyCharges") / 100.0, F.col("SeniorCitizen").cast("double")).alias("features"))
    new = sampling.oversample(rows, "Churn", "customerID")
    return new.select("synthetic_id", "base_id", "neighbour_id", "Churn", *[
        F.round(F.col("features")[i], 6).alias(n) for i, n in enumerate("abc")])


@query("retrain_weights_after_oversampling", f"""WITH {D.CUSTOMERS}, {D.OUTCOMES},
latest AS (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, id DESC) = 1),
weighed AS (
  SELECT "Churn" AS y, CASE outcome WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM customers LEFT JOIN latest ON CAST(k AS VARCHAR) = customer_id),
counts AS (SELECT y, count(*) AS n FROM weighed GROUP BY y),
rows AS (
  SELECT y, weight, 0 AS is_new, count(*) AS n FROM weighed GROUP BY ALL
  UNION ALL SELECT (SELECT y FROM counts ORDER BY n, y LIMIT 1), 1.0::DOUBLE, 1, (SELECT max(n) - min(n) FROM counts))
SELECT y, weight, is_new, n::BIGINT AS n FROM rows WHERE n > 0""")
def retrain_weights_after_oversampling(spark, sf):
    """Rows a retraining learns from: customers weighed by their last outcome, new rows at 1."""
    rows = D.customers(spark, sf, churn=True).select("customerID", "Churn", F.array(
        F.col("tenure") / 80.0, F.col("MonthlyCharges") / 100.0, F.col("SeniorCitizen").cast("double")).alias("features"))
    weighed = outcomes.sample_weights(rows, D.outcomes(spark, sf), "customerID")
    learned = sampling.balanced(settle(weighed, "weighed"), "Churn", "customerID", weight="weight")
    return learned.groupBy(F.col("Churn").alias("y"), "weight", F.col("customerID").startswith("new:").cast("int").alias("is_new")).agg(
        F.count(F.lit(1)).alias("n"))
