import pytest
from pyspark.sql import functions as F

from keepwell.functions import features
from keepwell.operators import quality
from keepwell.plans.jobs import cleaned_customers
from keepwell.sources import contracts


def test_blank_total_is_tenure_times_charge(spark):
    rows = spark.createDataFrame(
        [(1, 0, 50.0, " "), (2, 12, 80.0, "960.0"), (3, 3, 10.0, "n/a"), (4, 2, 5.0, None), (5, 2, 5.0, "NaN")],
        "id int, tenure int, MonthlyCharges double, TotalCharges string")
    found = {r.id: r.TotalCharges for r in quality.coerce_totals(rows).collect()}
    assert found == {1: 0.0, 2: 960.0, 3: 30.0, 4: 10.0, 5: 10.0}


def test_first_row_per_key_survives_and_null_is_one_key(spark):
    rows = spark.createDataFrame([(1000, 2, "b"), (1000, 1, "a"), (None, 4, "d"), (None, 3, "c"), (7, 5, "e")],
                                 "CustomerId int, seq int, v string")
    found = {r.CustomerId: (r.v, r.n_dups) for r in quality.keep_first(rows, "CustomerId", ["seq"]).collect()}
    assert found == {1000: ("a", 1), None: ("c", 1), 7: ("e", 0)}


def test_bad_first_label_removes_the_customer(spark):
    rows = spark.createDataFrame(
        [("a", 1, None), ("a", 2, "Yes"), ("b", 3, "No"), ("c", 4, "Maybe")],
        "customerID string, ingest_place int, Churn string").withColumns(
        {"tenure": F.lit(1), "MonthlyCharges": F.lit(1.0), "TotalCharges": F.lit("1")})
    assert [r.customerID for r in cleaned_customers(rows).collect()] == ["b"]


def test_overlap_counts_distinct_keys_as_text(spark):
    left = spark.createDataFrame([("1",), ("2",), ("3",), ("3",)], "customerID string")
    right = spark.createDataFrame([(2,), (3,), (4,)], "CustomerId int")
    r = quality.key_overlap(left, right, "customerID", "CustomerId").first()
    assert (r.n_left, r.n_right, r.n_both) == (3, 3, 2) and r.rate == pytest.approx(2 / 3, abs=1e-4)
    assert quality.key_overlap(left.limit(0), right, "customerID", "CustomerId").first().rate == 0.0
    assert quality.key_overlap(left, right, "customerID", "nope").first().rate == 0.0


def test_range_flags_ignore_nan_and_null(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (201.0,), (-1.0,), (200.0,), (0.0,)], "m double")
    assert quality.range_report(rows, {"m": (0, 200)}).first().n_out == 2


def test_all_missing_columns_are_reported(spark):
    rows = spark.createDataFrame([("a",)], "customerID string")
    with pytest.raises(contracts.ContractError) as error:
        contracts.require_columns(rows, contracts.BANK)
    assert "CreditScore" in str(error.value) and "EstimatedSalary" in str(error.value)
    assert "Surname" not in str(error.value)


def test_contract_violations_by_rule(spark):
    contract = contracts.load_contract({
        "title": "t", "required": ["a", "b"],
        "properties": {"a": {"type": "string", "enum": ["x", "y"]},
                       "b": {"type": "integer", "minimum": 0, "maximum": 5},
                       "c": {"type": ["integer", "number", "null"]}, "d": {"type": ["string", "number"]}}})
    assert [f.dataType.simpleString() for f in contract.schema().fields] == ["string", "int", "double", "string"]
    rows = spark.createDataFrame([("x", "1", 1.0), ("z", "6", None), (None, "-1", 2.0), ("y", "2.5", 3.0), ("y", "q", 3.0)],
                                 "a string, b string, c double")
    found = {(r.column_name, r.rule): r.n_bad for r in contracts.violations(rows, contract).collect()}
    assert found == {("a", "required"): 1, ("a", "enum"): 1, ("b", "required"): 0, ("b", "type"): 2,
                     ("b", "minimum"): 1, ("b", "maximum"): 1}


def test_gates_name_every_finding(spark):
    rows = spark.createDataFrame(
        [(i, i % 2, None if i < 3 else 1.0, 5.0, (i % 2) * 2.0, 0) for i in range(20)],
        "x int, Churn int, holes double, flat double, leak double, public_complaint_flag int")
    with pytest.raises(quality.QualityError) as error:
        quality.require_quality(rows, "Churn")
    message = str(error.value)
    assert "null_rate: holes" in message and "zero_variance: flat" in message and "target_leakage: leak" in message
    assert "public_complaint_flag" not in message
    quality.require_quality(rows.select("x", "Churn", "public_complaint_flag"), "Churn")


@pytest.mark.parametrize("tenure, stored, reported", [
    (0, "<12 months", "<12 months"), (11, "<12 months", "<12 months"), (12, "<12 months", "12-24 months"),
    (24, "12-24 months", "12-24 months"), (25, "24-48 months", "24-48 months"), (48, "24-48 months", "24-48 months"),
    (49, ">48 months", ">48 months"), (73, ">48 months", ">48 months"), (74, None, ">48 months"),
])
def test_both_band_definitions(spark, tenure, stored, reported):
    r = spark.range(1).select(features.stored_tenure_band(F.lit(tenure)), features.report_segment(F.lit(tenure))).first()
    assert tuple(r) == (stored, reported)


def test_codes(spark):
    rows = spark.createDataFrame([("Yes", "One year"), ("No", "x"), (None, None), ("1", "Two year")], "p string, c string")
    codes = {"Month-to-month": 0, "One year": 1, "Two year": 2}
    found = rows.select(features.yes_no(F.col("p")), features.yes_no(F.col("p"), 0),
                        features.coded(F.col("c"), codes, None), features.coded(F.col("c"), codes)).collect()
    assert [tuple(r) for r in found] == [(1, 1, 1, 1), (0, 0, None, 0), (None, 0, None, 0), (1, 1, 2, 2)]


def test_training_and_scoring_see_the_same_inputs(spark):
    raw = spark.createDataFrame([("Yes", "No internet service", "Month-to-month", 3, 50.0, " ")],
                                "Partner string, TechSupport string, Contract string, tenure int, "
                                "MonthlyCharges double, TotalCharges string")
    r = features.model_inputs(raw).first()
    assert (r.Partner, r.TechSupport, r.contract_type_encoded, r.is_high_risk_contract, r.TotalCharges) == (1, 0, 0, 1, 0.0)
    filled = features.in_contract_order(features.with_defaults(raw), ["CreditScore", "tenure", "unknown"], []).first()
    assert tuple(filled) == (650.0, 3.0, 0.0)
