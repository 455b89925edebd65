"""Word-list features on hand-worked texts."""

import hashlib

import pytest

from keepwell.functions import text as T
from keepwell.operators import tickets

# Ticket texts with known answers (text, topics, urgency, sentiment, escalation).
CASES = [
    # "issue" holds "sue"
    ("I was billed $80 instead of $50 as per my contract. Please correct this immediately. This is billing issue.",
     ["billing"], "high", 0.0, True),
    ("My internet speed is less than 5 Mbps and I am paying for Fiber 100. This is terrible performance.",
     ["performance"], "low", -0.6, False),
    ("Verizon is offering a similar plan for $40/month. Can you match this price or I will switch to competitor.",
     ["billing", "competitor"], "low", 0.0, True),
    ("Please cancel my account at the end of the month. I am moving out of the country.",
     ["cancellation"], "critical", 0.0, True),
    ("We have had no internet connection since this morning. Network outage is unacceptable.",
     ["performance"], "critical", -0.6, False),
    ("My credit card was charged twice for the last bill. Please refund the duplicate charge.",
     ["billing"], "low", 0.0, False),
    ("The router you sent me has no power light and won't turn on. I need a replacement device.",
     ["performance"], "low", 0.0, False),
    ("My service was down for 3 days last week. I want a credit on my next bill for the disruption.",
     ["billing", "performance"], "high", -0.6, False),
    ("My 1-year contract is expiring next week. If you can't offer a discount, I am leaving.",
     ["cancellation"], "low", 0.0, False),
    ("I am very angry! My bill was $30 extra this month and I want to cancel my subscription immediately!",
     ["billing", "cancellation"], "critical", -0.6, True),
    ("I need immediate help", ["other"], "medium", 0.0, False),
    ("hello", ["other"], "low", 0.0, False),
    ("", ["other"], "low", 0.0, False),
    ("unsatisfied but thankful, good, great, happy, lovely, helpful", ["other"], "medium", 0.8, False),
    ("bad terrible worst hate broken angry", ["other"], "low", -1.0, False),
    (None, [], "low", 0.0, False),
]


def test_features_of_known_texts(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, body string")
    found = {r.i: r for r in T.with_features(rows, "body").collect()}
    for i, (body, topics, urgency, sentiment, escalation) in enumerate(CASES):
        r = found[i]
        assert (r.complaint_topics, r.urgency_level, r.escalation_flag) == (topics, urgency, escalation), body
        assert r.sentiment_score == pytest.approx(sentiment), body


def test_helper_columns_do_not_leak(spark):
    rows = spark.createDataFrame([("x",)], "body string")
    assert T.with_features(rows, "body").columns == [
        "body", "sentiment_score", "urgency_level", "complaint_topics", "escalation_flag"]


@pytest.mark.parametrize("body", ["  a b\t\n", " café ", "plain", "\x1c x \x85", "   "])
def test_hash_is_of_the_text_as_python_strips_it(spark, body):
    found = spark.createDataFrame([(body,)], "body string").select(T.content_hash(T.F.col("body"))).first()[0]
    assert found == hashlib.sha256(body.strip().encode()).hexdigest()


def test_extended_lexicon_leaves_the_default_alone(spark):
    more = T.DEFAULT_LEXICON.extended(topics={"billing": ["zzz"]}, negative=["zzz"])
    rows = spark.createDataFrame([("zzz",)], "body string")
    assert T.with_features(rows, "body", more).first().complaint_topics == ["billing"]
    assert T.with_features(rows, "body").first().complaint_topics == ["other"]


def test_extraction_answers_get_defaults(spark):
    rows = spark.createDataFrame([
        ('{"sentiment_score": -0.5, "urgency_level": "HIGH", "complaint_topics": ["billing"], "escalation_flag": true}',),
        ("{}",), ("not json",),
    ], "payload string")
    parsed = rows.select(*[c.alias(n) for n, c in T.parsed_extraction(T.F.col("payload")).items()]).collect()
    assert tuple(parsed[0]) == (-0.5, "high", ["billing"], True)
    assert tuple(parsed[1]) == tuple(parsed[2]) == (0.0, "low", ["other"], False)


def test_topics_of_any_lexicon_reach_the_customer(spark):
    lexicon = T.DEFAULT_LEXICON.extended(topics={"delivery": ["parcel"], "billing": ["quittance"]})
    rows = [("c1", "my parcel is lost"), ("c1", "wrong quittance"), ("c2", "hello"), (None, "parcel")]
    marked = tickets.with_text_features(spark.createDataFrame(rows, "customerID string, body string"), "body", lexicon)
    found = {r.customerID: r.complaint_topics for r in tickets.topics_per_customer(marked, lexicon=lexicon).collect()}
    assert found == {"c1": ["billing", "delivery"], "c2": ["other"]}
