"""Nearest vectors, customer cases, briefings and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import features, render, values as V
from keepwell.operators import corpus, neighbours, tickets, vector_index
from keepwell.plans import views as D
from keepwell.plans.registry import query, rounded
from keepwell.plans.risk import _with_drivers, _PARTS, _PHRASE
from keepwell.session import scratch_path

_K = 10
_CENTRES = """centres AS (
  SELECT label AS query_id, list(m ORDER BY d) AS q FROM (
    SELECT label, d, avg(v::DOUBLE) AS m FROM (
      SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d)
  GROUP BY label)"""


def _near_sql(k: int) -> str:
    return f"""{_CENTRES}, pairs AS (
  SELECT query_id, vec_id AS neighbour_id, label, round(list_sum(list_transform(
    list_zip(q, embedding), lambda z: (z[1] - z[2]::DOUBLE) * (z[1] - z[2]::DOUBLE))), 6) AS distance
  FROM centres, embeddings),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS position FROM pairs
  QUALIFY position <= {k})"""


def _near(spark, sf, k=_K):
    """The vectors nearest to the centre of each label: few questions against the whole corpus."""
    vectors = D.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return neighbours.nearest_to_few(_label_centres(vectors), vectors, k, "query_id", "vec_id")


def _label_centres(vectors):
    places = vectors.select("label", F.posexplode("vector").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("m"))
    return places.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("p")).select(
        F.col("label").alias("query_id"), F.transform("p", lambda x: x["m"]).alias("vector"))


def _kinds(spark, sf):
    return D.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("neighbour_id"), F.when(F.col("label") < 3, "section").otherwise("case").alias("kind"))


@query("knn_l2", f"WITH {_near_sql(_K)} SELECT query_id, neighbour_id, distance, position FROM near")
def knn_l2(spark, sf):
    return _near(spark, sf)


@query("knn_stored_index", f"WITH {_near_sql(_K)} SELECT query_id, neighbour_id, distance, position FROM near")
def knn_stored_index(spark, sf):
    """The same neighbours from a stored index that was built on a part of the vectors and then added to."""
    vectors = D.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    root = scratch_path(spark, "vector-index")
    vector_index.build(vectors.where("vec_id % 3 != 0"), root, "vec_id")
    vector_index.append(vectors.where("vec_id % 3 = 0"), root, "vec_id")
    return vector_index.search(_label_centres(vectors), root, _K, "query_id")


@query("knn_type_caps", f"""WITH {_near_sql(_K)}
SELECT query_id, neighbour_id, CASE WHEN label < 3 THEN 'section' ELSE 'case' END AS kind, position,
  row_number() OVER (PARTITION BY query_id, label < 3 ORDER BY position)::INT AS kind_position
FROM near QUALIFY kind_position <= CASE WHEN label < 3 THEN 1 ELSE 5 END""")
def knn_type_caps(spark, sf):
    capped = neighbours.cap_by_kind(_near(spark, sf), _kinds(spark, sf), {"section": 1, "case": 5})
    return capped.select("query_id", "neighbour_id", "kind", "position", "kind_position")


@query("question_section", f"""WITH {_near_sql(3)}
SELECT query_id, neighbour_id, distance, position FROM near WHERE label < 3
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) = 1""")
def question_section(spark, sf):
    """The first section among the three nearest texts of a question; a question without one has no row."""
    hits = neighbours.first_of_kind(_near(spark, sf, 3), _kinds(spark, sf), "section")
    return hits.select("query_id", "neighbour_id", "distance", "position")


def _case_rows(spark, sf):
    log = D.outcomes(spark, sf).groupBy("customer_id").agg(
        F.max_by(F.struct("intervention_type", "outcome"), F.struct("timestamp", "id")).alias("last"))
    latest = log.select(F.col("customer_id").cast("long").alias("account_id"), "last.*")
    rolled = tickets.rollup(tickets.with_text_features(D.tickets(spark, sf), lexicon=D.LEXICON)).select(
        F.col("customerID").cast("long").alias("account_id"), F.col("ticket_sentiment_score").alias("sentiment_score"),
        F.col("ticket_escalation_flag").alias("escalation_flag"))
    rows = features.model_inputs(D.customers(spark, sf, churn=True)).join(rolled, "account_id", "left").na.fill(
        {"sentiment_score": 0.0, "escalation_flag": 0})
    known = rows.select("account_id", "customerID").join(latest, "account_id").drop("account_id")
    return corpus.cases(rows, known)


_TURNS = D.text_features_sql("(SELECT * FROM conversations WHERE role = 'user')", "conv_id, turn")
_CASES = f"""{D.CUSTOMERS}, {D.OUTCOMES}, {_TURNS},
rolled AS (SELECT conv_id, avg(sentiment_score) AS s, max(escalation_flag) AS e FROM featured GROUP BY conv_id),
latest AS (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY "timestamp" DESC, id DESC) = 1),
told AS (
  SELECT "customerID", '[HISTORICAL CASE] Customer ID: ' || "customerID" || '. Profile: tenure ' || tenure
    || ' months, contract ' || CASE WHEN "Contract" IN ('One year', 'Two year') THEN 'yearly' ELSE 'month-to-month' END
    || ', MonthlyCharges $' || printf('%.2f', "MonthlyCharges")
    || ', OnlineSecurity ' || CASE WHEN "OnlineSecurity" = 'Yes' THEN 'Yes' ELSE 'No' END
    || ', TechSupport ' || CASE WHEN "TechSupport" = 'Yes' THEN 'Yes' ELSE 'No' END
    || '. Support History: sentiment ' || printf('%.2f', round(coalesce(s, 0.0::DOUBLE), 6))
    || ', escalation ' || CASE WHEN e = 1 THEN 'Yes' ELSE 'No' END
    || '. Intervention Taken: ' || coalesce(intervention_type, 'none')
    || ' Outcome: ' || CASE outcome WHEN 1 THEN 'Customer was retained.' WHEN 0 THEN 'Customer churned anyway.'
      ELSE 'not logged.' END AS text
  FROM customers LEFT JOIN rolled ON account_id = conv_id
  LEFT JOIN latest ON CAST(account_id AS VARCHAR) = customer_id WHERE "Churn" = 1)"""


@query("case_text", f'WITH {_CASES} SELECT "customerID", text FROM told')
def case_text(spark, sf):
    return _case_rows(spark, sf)


_SECTIONS = """sections AS (
  SELECT n_nationkey, '[PLAYBOOK SECTION: ' || n_name || ']' || chr(10) || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE
    'Strategy: Offer a call from the ' || r_name || ' desk.' || chr(10) END || 'Key drivers: tenure.' || chr(10)
    || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'Estimated success rate: ' || (50 + n_nationkey) || '% of callers.' END
    AS section, CASE WHEN n_nationkey % 5 = 0 THEN 'Offer standard retention outreach.'
      ELSE 'Offer a call from the ' || r_name || ' desk.' END AS action,
    CASE WHEN n_nationkey % 3 = 0 THEN '80%' ELSE (50 + n_nationkey) || '%' END AS rate
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _sections(spark, sf):
    key = F.col("n_nationkey")
    rows = D.table(spark, sf, "nation").join(
        D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", F.concat(
        F.lit("[PLAYBOOK SECTION: "), "n_name", F.lit("]\n"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Strategy: Offer a call from the "), "r_name", F.lit(" desk.\n"))),
        F.lit("Key drivers: tenure.\n"),
        F.when(key % 3 == 0, "").otherwise(F.concat(
            F.lit("Estimated success rate: "), (key + 50).cast("string"), F.lit("% of callers.")))).alias("section"))


@query("briefing_text", f"""WITH {_PARTS}, {_SECTIONS},
told AS (
  SELECT "customerID", account_id, tenure, place, coalesce(CASE "Contract" WHEN 'Month-to-month' THEN 0
    WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 END, 0) AS code, feature AS d
  FROM placed JOIN scored USING ("customerID") WHERE p >= 0.32::DOUBLE),
asked AS (SELECT "customerID", account_id, 'customer' || string_agg({_PHRASE}, '' ORDER BY place) AS q
  FROM told GROUP BY ALL)
SELECT "customerID", 'This customer is at high risk of churn due to characteristics matching: ''' || q
  || '''. Historical cases show that customers with similar features were successfully retained or churned depending '
  || 'on immediate outreach. Recommended Action: ' || action || ' (estimated success probability is ' || rate || ').'
  AS briefing
FROM asked JOIN customer ON c_custkey = account_id JOIN sections ON c_nationkey = n_nationkey""")
def briefing_text(spark, sf):
    rows = _with_drivers(spark, sf).where("action_needed = 1").withColumns({
        "contract_type_encoded": features.coded(F.col("Contract"), V.CONTRACT_CODES),
        "escalation_flag": F.lit(0), "sentiment_score": F.lit(0.0)})
    nations = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"),
                                                    F.col("c_nationkey").alias("n_nationkey"))
    asked = render.with_query_text(rows, output="q").select("customerID", "account_id", "q")
    return asked.join(nations, "account_id").join(_sections(spark, sf), "n_nationkey").select(
        "customerID", render.briefing(F.col("q"), F.col("section")).alias("briefing"))


@query("corpus_union", f"""WITH {_CASES}, {_SECTIONS}
SELECT 'section-' || n_nationkey || '-1' AS doc_id, 'section' AS kind, trim(section, chr(10) || ' ') AS text FROM sections
UNION ALL SELECT 'case-' || "customerID", 'case', text FROM told""")
def corpus_union(spark, sf):
    parts = corpus.sections(_sections(spark, sf), "n_nationkey", "section")
    return corpus.corpus(parts, _case_rows(spark, sf))


@query("term_weights", r"""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents),
counted AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 512 AS bucket, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) AS idf FROM counted GROUP BY bucket),
raw AS (SELECT doc_id, bucket, n * idf AS raw FROM counted JOIN idf USING (bucket))
SELECT doc_id, bucket, round(coalesce(raw / nullif(sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 0), 0), 6) AS weight FROM raw""")
def term_weights(spark, sf):
    return rounded(corpus.term_weights(D.table(spark, sf, "documents"), "doc_id"))
