"""Text features, ticket rollups and the extraction cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import text as T
from keepwell.operators import corpus, tickets
from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded
from keepwell.session import scratch_path
from keepwell.sources import tables

_SPACE = "'[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"
_STRIP = f"regexp_replace(%s, '^' || {_SPACE} || '|' || {_SPACE} || '$', '', 'g')"
_DOCS = D.text_features_sql("documents", "doc_id, text")
_TURNS = D.text_features_sql("(SELECT * FROM conversations WHERE role = 'user')", "conv_id, turn")


def _documents(spark, sf):
    return T.with_features(D.table(spark, sf, "documents"), "text", D.LEXICON)


@query("text_topics", f"""WITH {_DOCS}
SELECT doc_id, array_to_string(complaint_topics, ',') AS topics FROM featured""")
def text_topics(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join("complaint_topics", ",").alias("topics"))


@query("text_urgency", f"WITH {_DOCS} SELECT doc_id, urgency_level, escalation_flag FROM featured")
def text_urgency(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", "urgency_level", F.col("escalation_flag").cast("int").alias("escalation_flag"))


@query("text_sentiment", f"WITH {_DOCS} SELECT doc_id, round(sentiment_score, 6) AS sentiment_score FROM featured")
def text_sentiment(spark, sf):
    return rounded(_documents(spark, sf).select("doc_id", "sentiment_score"))


@query("text_dedup_cache", f"""WITH {_DOCS}
SELECT sha256({_STRIP % "text"}) AS ticket_hash, count(*) AS n_texts,
  round(any_value(sentiment_score), 6) AS sentiment_score, any_value(urgency_level) AS urgency_level,
  any_value(array_to_string(complaint_topics, ',')) AS complaint_topics, any_value(escalation_flag) AS escalation_flag
FROM featured GROUP BY 1""")
def text_dedup_cache(spark, sf):
    found = tables.distinct_text_features(D.table(spark, sf, "documents"), "text", D.LEXICON)
    return rounded(found.withColumns({
        "complaint_topics": F.array_join("complaint_topics", ","),
        "escalation_flag": F.col("escalation_flag").cast("int")}))


@query("text_cache_update", f"""
SELECT sha256({_STRIP % "text"}) AS ticket_hash, CASE WHEN bool_or(lang = 'en') THEN 1 ELSE 2 END AS version,
  (SELECT count(DISTINCT sha256({_STRIP % "text"})) FROM documents WHERE lang = 'en') AS n_reused
FROM documents GROUP BY 1""")
def text_cache_update(spark, sf):
    """Two deliveries: the English documents, then all; the second finds the first's texts in the cache."""
    docs = D.table(spark, sf, "documents")
    path = scratch_path(spark, "text-cache")
    tables.update_text_cache(docs.where("lang = 'en'"), "text", path, 1, D.LEXICON)
    _, reused = tables.update_text_cache(docs, "text", path, 2, D.LEXICON)
    return spark.read.parquet(path).select("ticket_hash", "version", F.lit(reused).cast("long").alias("n_reused"))


@query("json_normalise", """
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0.0::DOUBLE ELSE value END AS sentiment_score,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'low' ELSE event_type END AS urgency_level,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'other' ELSE event_type || ',' || event_type END AS complaint_topics,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 WHEN value > 50 THEN 1 ELSE 0 END AS escalation_flag
FROM events""")
def json_normalise(spark, sf):
    answer = F.to_json(F.struct(
        F.col("value").alias("sentiment_score"), F.upper("event_type").alias("urgency_level"),
        F.array("event_type", "event_type").alias("complaint_topics"), (F.col("value") > 50).alias("escalation_flag")))
    payload = (F.when(F.col("event_id") % 5 == 0, "{}")
               .when(F.col("event_id") % 7 == 0, '{"sentiment_score": ').otherwise(answer))
    rows = D.table(spark, sf, "events").select("event_id", payload.alias("payload"))
    parsed = rows.select("event_id", *[c.alias(n) for n, c in T.parsed_extraction(F.col("payload")).items()])
    return parsed.withColumns({"complaint_topics": F.array_join("complaint_topics", ","),
                               "escalation_flag": F.col("escalation_flag").cast("int")})


_CODE = "CASE urgency_level WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


def _topic(name: str) -> str:
    return f"max(list_contains(complaint_topics, '{name}')::INT) AS ticket_complaint_topics_{name}"


@query("ticket_rollup", f"""WITH {_TURNS}
SELECT CAST(conv_id AS VARCHAR) AS "customerID", round(avg(sentiment_score), 6) AS ticket_sentiment_score,
  ['low', 'medium', 'high', 'critical'][max({_CODE})] AS ticket_urgency_level,
  {_topic("billing")}, {_topic("competitor")}, {_topic("performance")},
  max(escalation_flag) AS ticket_escalation_flag
FROM featured GROUP BY conv_id""")
def ticket_rollup(spark, sf):
    return rounded(tickets.rollup(tickets.with_text_features(D.tickets(spark, sf), lexicon=D.LEXICON)))


@query("ticket_topics", f"""WITH {_TURNS}
SELECT CAST(conv_id AS VARCHAR) AS "customerID",
  array_to_string(list_sort(list_distinct(flatten(list(complaint_topics)))), ',') AS topics
FROM featured GROUP BY conv_id""")
def ticket_topics(spark, sf):
    found = tickets.topics_per_customer(tickets.with_text_features(D.tickets(spark, sf), lexicon=D.LEXICON), lexicon=D.LEXICON)
    return found.select("customerID", F.array_join("complaint_topics", ",").alias("topics"))


@query("customer_tickets", f"""WITH {D.CUSTOMERS}, {_TURNS},
rolled AS (SELECT conv_id, avg(sentiment_score) AS s, max({_CODE}) AS u, max(escalation_flag) AS e
  FROM featured GROUP BY conv_id)
SELECT "customerID", round(coalesce(s, 0.0::DOUBLE), 6) AS sentiment_score,
  coalesce(['low', 'medium', 'high', 'critical'][u], 'low') AS urgency_level, coalesce(e, 0) AS escalation_flag
FROM customers LEFT JOIN rolled ON account_id = conv_id""")
def customer_tickets(spark, sf):
    rolled = tickets.rollup(tickets.with_text_features(D.tickets(spark, sf), lexicon=D.LEXICON))
    rows = D.customers(spark, sf).select("customerID", F.col("account_id").cast("string").alias("account"))
    filled = tickets.fill_missing_tickets(rows, rolled.withColumnRenamed("customerID", "account"), "account")
    return rounded(filled.select("customerID", "sentiment_score", "urgency_level", "escalation_flag"))


@query("section_split", f"""
SELECT doc_id, unnest(range(1, len(parts) + 1))::INT AS section_no, unnest(parts) AS section FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda p: {_STRIP % "p"}), lambda p: p <> '') AS parts FROM documents)""")
def section_split(spark, sf):
    return corpus.sections(D.table(spark, sf, "documents"), "doc_id", "text", tag="\n")
