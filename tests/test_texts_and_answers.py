"""Rendered texts, drivers and reports."""

import pytest
from pyspark.sql import functions as F

from keepwell.functions import render, scoring
from keepwell.operators import corpus, explain, reports

PLAYBOOK = """[PLAYBOOK SECTION: Price]
Scenario: high bills.
Strategy: Offer a discount.
Key drivers: MonthlyCharges.
Estimated success rate: 85% for long-tenure customers; 65% otherwise.

[PLAYBOOK SECTION:

[PLAYBOOK SECTION: Loyalty]
Strategy: Call them
Key drivers: tenure.
"""


@pytest.mark.parametrize("value", [0.125, 2.345, 2.675, 1.005, 0.375, -0.7, -0.125, -2.345, 110.0, 22.585, 0.0, 1e6 + 0.005])
def test_two_decimals_print_like_python(spark, value):
    assert spark.range(1).select(render.two_decimals(F.lit(value))).first()[0] == f"{value:.2f}"


QUERY_CASES = [
    (["contract_type_encoded", "tenure", "TechSupport"], dict(contract_type_encoded=0, tenure=3, TechSupport=0),
     "customer month-to-month contract tenure 3 months no tech support"),
    (["contract_type_encoded", "tenure"], dict(contract_type_encoded=1, tenure=52),
     "customer one-year contract tenure 52 months"),
    (["MonthlyCharges", "sentiment_score"], dict(MonthlyCharges=75.0, sentiment_score=-0.7),
     "customer monthly charges $75.00 negative ticket sentiment -0.70"),
    (["contract_type_encoded", "tenure"], dict(contract_type_encoded=0, tenure=5),
     "customer month-to-month contract tenure 5 months"),
    (["contract_type_encoded", "escalation_flag", "sentiment_score"],
     dict(contract_type_encoded=0, escalation_flag=1, sentiment_score=-0.9),
     "customer month-to-month contract escalated support ticket negative ticket sentiment -0.90"),
    (["tenure", "MonthlyCharges"], dict(tenure=60, MonthlyCharges=95.0), "customer tenure 60 months monthly charges $95.00"),
    (["contract_type_encoded", "tenure"], dict(contract_type_encoded=2, tenure=2),
     "customer two-year contract tenure 2 months"),
    (["charges_per_tenure_month", "is_high_risk_contract", "OnlineSecurity"],
     dict(tenure=7, contract_type_encoded=1, OnlineSecurity=1),
     "customer tenure 7 months one-year contract has online security"),
    (["login_trend"], {}, "customer high churn risk"),
    (["ticket_sentiment_score"], dict(sentiment_score=0.0), "customer neutral sentiment 0.00"),
]


@pytest.mark.parametrize("drivers, row, expected", QUERY_CASES)
def test_query_texts(spark, drivers, row, expected):
    values = dict(contract_type_encoded=0, tenure=0, MonthlyCharges=0.0, TechSupport=0, OnlineSecurity=0,
                  escalation_flag=0, sentiment_score=0.0) | row
    df = spark.createDataFrame([(drivers, *values.values())], "drivers array<string>, contract_type_encoded int, "
                               "tenure int, MonthlyCharges double, TechSupport int, OnlineSecurity int, "
                               "escalation_flag int, sentiment_score double")
    assert render.with_query_text(df, "drivers").first().query_text == expected


def test_sections_and_briefings(spark):
    parts = corpus.sections(spark.createDataFrame([("p", PLAYBOOK)], "path string, text string"), "path", "text").orderBy("section_no").collect()
    assert [(r.section_no, r.section.split("\n")[0]) for r in parts] == [
        (1, "[PLAYBOOK SECTION: Price]"), (2, "[PLAYBOOK SECTION: Loyalty]")]
    rows = spark.createDataFrame([(r.section,) for r in parts] + [(None,)], "section string")
    told = [r[0] for r in rows.select(render.briefing(F.lit("customer x"), F.col("section"))).collect()]
    assert told[0].endswith("Recommended Action: Offer a discount. (estimated success probability is 85%).")
    assert told[1].endswith("Recommended Action: Call them (estimated success probability is 80%).")
    assert "Offer standard retention outreach." in told[2]
    assert all("characteristics matching: 'customer x'." in t for t in told)


def test_scorecard_limits_and_confidence(spark):
    rows = spark.createDataFrame([("Month-to-month", 6, "Fiber optic"), ("Two year", 7, "DSL"), (None, None, None)],
                                 "Contract string, tenure int, InternetService string")
    found = scoring.scored(rows, 0.32).collect()
    assert [round(r.churn_score, 6) for r in found] == [0.87, 0.15, 0.15]
    assert found[0].confidence == 1.0 and found[1].confidence == pytest.approx(0.34)
    assert [r.risk_level for r in found] == ["High Risk", "Low Risk", "Low Risk"]


def test_contributions_add_up_and_ties_go_by_name(spark):
    rows = spark.createDataFrame([("Month-to-month", 1, "DSL"), ("One year", 30, "DSL")], "Contract string, tenure int, InternetService string")
    out = explain.additive_contributions(rows, scoring.points()).withColumn("p", scoring.scorecard()).collect()
    mean = sum(r.p for r in out) / 2
    for r in out:
        assert mean + sum(c.value for c in r.contributions) == pytest.approx(r.p)
    tied = spark.sql("SELECT array(named_struct('feature','b','value',-1D), named_struct('feature','a','value',1D), "
                     "named_struct('feature','c','value',0.5D), named_struct('feature','d','value',0D)) AS c")
    assert tied.select(explain.top_drivers(F.col("c"))).first()[0] == ["a", "b", "c"]


def test_ids_are_numbered_by_order(spark):
    rows = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "place int, v string")
    found = {r.v: r.customerID for r in reports.with_customer_id(rows, "place").collect()}
    assert found == {"a": "CUST-0000", "b": "CUST-0001", "c": "CUST-0002"}
    renamed = reports.with_customer_id(rows.withColumnRenamed("v", "CustomerId"), "place")
    assert renamed.columns == ["customerID", "place"]


def test_question_answers(spark):
    rows = spark.createDataFrame([(f"c{i}", 0.1 * i, 10.0 * i, int(i % 2 == 0)) for i in range(1, 10)],
                                 "customerID string, churn_score double, MonthlyCharges double, escalation_flag int")
    assert reports.price_sensitive(rows).count() == 2
    assert reports.escalated_at_risk(rows).count() == 3
    top = reports.first_answers(reports.escalated_at_risk(rows), n=2).collect()
    assert [r.customerID for r in top] == ["c8", "c6"] and {r.n_found for r in top} == {3}


def test_embedded_texts_find_their_like(spark):
    from keepwell.operators.neighbours import nearest

    docs = spark.createDataFrame([("a", "price discount bill"), ("b", "slow network outage"), ("c", "loyal account manager")],
                                 "id string, text string")
    model = corpus.fit_embedding(docs)
    asked = corpus.embed(spark.createDataFrame([("q", "network outage again")], "id string, text string"), model)
    hit = nearest(asked, corpus.embed(docs, model), 1).first()
    assert hit.neighbour_id == "b"
