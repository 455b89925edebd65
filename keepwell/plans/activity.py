"""Logins, contacts, amounts, mentions and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import text as T
from keepwell.operators import events, tickets
from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded

_NOW = f"TIMESTAMP '{D.AS_OF}'"


def _last(days: int) -> str:
    return f"count(*) FILTER (ts > {_NOW} - INTERVAL {days} DAYS AND ts <= {_NOW})"


@query("login_rolling", f"""
SELECT user_id, round({_last(7)} / 7.0::DOUBLE, 6) AS logins_7d_rolling_avg,
  round({_last(30)} / 30.0::DOUBLE, 6) AS logins_30d_rolling_avg,
  round({_last(7)} / 7.0::DOUBLE - {_last(30)} / 30.0::DOUBLE, 6) AS login_trend,
  date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31')::INT AS days_since_last_login
FROM events WHERE ts <= {_NOW} GROUP BY user_id""")
def login_rolling(spark, sf):
    return rounded(events.login_features(D.table(spark, sf, "events"), "user_id", "ts", D.AS_OF))


@query("login_daily_rolling", """
WITH days AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, day, n,
  round(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)
    / 7.0::DOUBLE, 6) AS avg_7d,
  round(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)
    / 30.0::DOUBLE, 6) AS avg_30d
FROM days""")
def login_daily_rolling(spark, sf):
    return rounded(events.daily_rolling(D.table(spark, sf, "events"), "user_id", "ts"))


@query("support_contacts", f"""
SELECT user_id, count(*) AS n_all, {_last(30)} AS n_recent, {_last(15)} AS n_half FROM events
WHERE event_type = 'error' GROUP BY user_id""")
def support_contacts(spark, sf):
    errors = D.table(spark, sf, "events").where("event_type = 'error'")
    month = tickets.contacts(errors, "user_id", "ts", D.AS_OF, 30)
    half = tickets.contacts(errors, "user_id", "ts", D.AS_OF, 15).select(
        "user_id", F.col("n_recent").alias("n_half"))
    return events.join_features(month, [half], "user_id")


@query("mom_delta", """
WITH months AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS total
  FROM orders GROUP BY ALL)
SELECT a.o_custkey, strftime(a.month, '%Y-%m') AS month, round(a.total, 2) AS total,
  round((a.total - b.total) / b.total, 6) AS delta
FROM months a LEFT JOIN months b ON b.o_custkey = a.o_custkey AND b.month = a.month - INTERVAL 1 MONTH""")
def mom_delta(spark, sf):
    found = events.month_over_month(D.table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(rounded(found, 2, ["total"]), 6, ["delta"])


@query("mention_volume", f"""
SELECT event_type, count(*) FILTER ((contains(props, '7') OR contains(props, '11'))
  AND ts > {_NOW} - INTERVAL 7 DAYS AND ts <= {_NOW}) AS n_mentions FROM events GROUP BY event_type""")
def mention_volume(spark, sf):
    return events.mention_volume(D.table(spark, sf, "events"), "props", "event_type", ["7", "11"], "ts", D.AS_OF)


_NAMES = " OR ".join(f"contains(lower(text), '{w}')" for w in D.LEXICON.topics["competitor"])


@query("mention_volume_by_source", f"""
SELECT source, count(*) FILTER ({_NAMES}) AS n_mentions FROM documents GROUP BY source""")
def mention_volume_by_source(spark, sf):
    return events.mention_volume(D.table(spark, sf, "documents"), "text", "source", D.LEXICON.topics["competitor"])


@query("review_rates", f"""WITH {D.text_features_sql("documents", "doc_id, source")}
SELECT source, (doc_id % 12 + 1)::INT AS month, round(avg(sentiment_score), 6) AS avg_sentiment,
  round(avg(CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS one_star_rate
FROM featured GROUP BY ALL""")
def review_rates(spark, sf):
    reviews = T.with_features(D.table(spark, sf, "documents"), "text", D.LEXICON).select(
        "source", (F.col("doc_id") % 12 + 1).cast("int").alias("month"), (F.col("doc_id") % 5 + 1).alias("rating"),
        "sentiment_score")
    return rounded(events.review_rates(reviews, ["source", "month"], "sentiment_score", "rating"))
