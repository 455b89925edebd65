"""Streaming jobs over the given tables, run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded
from keepwell.session import scratch_path
from keepwell.streaming import jobs


def _stream(spark, sf, name):
    return jobs.read_files(spark, f"{sf}/{name}.parquet", D.table(spark, sf, name).schema)


def _naive(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query("stream_login_windows", """
WITH opened AS (
  SELECT user_id, CAST(ts AS DATE) - CAST(unnest(range(0, 7)) AS INT) AS first_day FROM events),
closed AS (
  SELECT CAST(first_day AS TIMESTAMP) AS window_start, CAST(first_day AS TIMESTAMP) + INTERVAL 7 DAYS AS window_end,
    user_id, count(*) AS n FROM opened GROUP BY ALL)
SELECT * FROM closed WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_login_windows(spark, sf):
    windows = jobs.login_windows(_stream(spark, sf, "events"), "user_id", "ts")
    done = jobs.run_available(windows, "login-windows")
    return done.select(_naive("window_start"), _naive("window_end"), "user_id", "n")


@query("stream_login_windows_30d", """
WITH opened AS (
  SELECT user_id, CAST(ts AS DATE) - CAST(unnest(range(0, 30)) AS INT) AS first_day FROM events),
closed AS (
  SELECT CAST(first_day AS TIMESTAMP) + INTERVAL 30 DAYS AS window_end, user_id, count(*) / 30.0::DOUBLE AS a
  FROM opened GROUP BY ALL)
SELECT window_end, user_id, round(a, 6) AS logins_30d_rolling_avg FROM closed
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_login_windows_30d(spark, sf):
    windows = jobs.login_windows(_stream(spark, sf, "events"), "user_id", "ts", "30 days")
    done = jobs.run_available(windows, "login-windows-30d")
    return rounded(jobs.login_averages(done, "user_id", 30).select(_naive("window_end"), "user_id", "logins_30d_rolling_avg"))


def _deliveries(spark, sf):
    """Every outcome is delivered again at once, and once more forty days later."""
    events = _stream(spark, sf, "events").where("event_type IN ('purchase', 'error')")
    return events.withColumn("delay", F.explode(F.array(F.lit(0), F.lit(0), F.lit(40)))).select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("customer_id"),
        (F.col("event_type") == "purchase").cast("int").alias("outcome"),
        (F.col("ts") + F.make_interval(days=F.col("delay"))).alias("timestamp"))


@query("stream_outcome_dedup", f"""WITH {D.OUTCOMES}
SELECT id, customer_id, outcome FROM outcomes""")
def stream_outcome_dedup(spark, sf):
    return jobs.log_outcomes(_deliveries(spark, sf), scratch_path(spark, "outcomes")).select("id", "customer_id", "outcome")


@query("stream_outcome_rejects", f"""WITH {D.OUTCOMES}
SELECT 'logged' AS state, id, customer_id, outcome FROM outcomes WHERE id % 7 != 0
UNION ALL SELECT 'rejected', NULL, customer_id, outcome FROM outcomes, range(3) WHERE id % 7 = 0""")
def stream_outcome_rejects(spark, sf):
    """Some outcomes come without an identifier: each delivery of them is kept, apart from the log."""
    some = F.when(F.col("id") % 7 != 0, F.col("id"))
    delivered, root = _deliveries(spark, sf).withColumn("id", some), scratch_path(spark, "outcomes")
    logged = jobs.log_outcomes(delivered, root).withColumn("state", F.lit("logged"))
    rejected = jobs.rejected_outcomes(spark, root, delivered.schema).withColumn("state", F.lit("rejected"))
    return logged.unionByName(rejected).select("state", "id", "customer_id", "outcome")


@query("stream_ticket_features", f"""
WITH {D.text_features_sql("(SELECT * FROM conversations WHERE role = 'user')", "conv_id, turn")}
SELECT CAST(conv_id AS VARCHAR) AS "customerID", turn, round(sentiment_score, 6) AS sentiment_score, urgency_level,
  array_to_string(complaint_topics, ',') AS topics, escalation_flag FROM featured""")
def stream_ticket_features(spark, sf):
    turns = _stream(spark, sf, "conversations").where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("customerID"), "turn", "text")
    done = jobs.run_available(jobs.ticket_features(turns, "text", D.LEXICON), "tickets")
    return rounded(done.select(
        "customerID", "turn", "sentiment_score", "urgency_level",
        F.array_join("complaint_topics", ",").alias("topics"), F.col("escalation_flag").cast("int").alias("escalation_flag")))


@query("stream_risk_scores", f"""WITH {D.CUSTOMERS},
joined AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS "customerID",
    CASE WHEN c.k IS NULL THEN 'Two year' ELSE c."Contract" END AS contract,
    CASE WHEN c.k IS NULL THEN 3 ELSE c.tenure END AS tenure,
    CASE WHEN c.k IS NULL THEN 'Fiber optic' ELSE c."InternetService" END AS internet
  FROM orders LEFT JOIN (SELECT * FROM customers WHERE "Contract" IS NOT NULL) c ON c.k = o_orderkey),
points AS (
  SELECT "customerID", least(0.96::DOUBLE, greatest(0.04::DOUBLE, 0.15::DOUBLE
    + CASE WHEN contract = 'Month-to-month' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN tenure <= 6 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN internet = 'Fiber optic' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END)) AS p FROM joined)
SELECT "customerID", round(p, 6) AS churn_score,
  CASE WHEN p >= 0.32::DOUBLE THEN 'High Risk' ELSE 'Low Risk' END AS risk_level FROM points""")
def stream_risk_scores(spark, sf):
    requests = _stream(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("customerID"), F.lit("Two year").alias("Contract"),
        F.lit(3).alias("tenure"), F.lit("Fiber optic").alias("InternetService"))
    snapshot = D.customers(spark, sf, accounts=False).where("Contract IS NOT NULL").select(
        "customerID", "Contract", "tenure", "InternetService")
    done = jobs.run_available(jobs.scored_requests(requests, snapshot), "scores")
    return rounded(done.select("customerID", "churn_score", "risk_level"))
