"""The given tables seen as the tables of the retention domain.

Every view exists twice: as a DataFrame and as an SQL text for the oracle. The
two are written independently where the computation is not trivial.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keepwell.functions import scoring
from keepwell.functions.text import DEFAULT_LEXICON

AS_OF = "2024-01-31 00:00:00"
CHURN_DAYS = 180

# default words plus syllables of the invented languages, so that every list hits
LEXICON = DEFAULT_LEXICON.extended(
    topics={"billing": ["tion"], "performance": ["sch"], "competitor": ["reth"], "cancellation": ["lyi"]},
    urgency={"critical": ["nges"], "fault": ["ción"], "question": ["eau"], "hurry": ["ing"]},
    negative=["reth", "lyi", "nges", "eau"],
    positive=["tion", "ther", "ich"],
    escalation=["ción", "que"],
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_days(orders: DataFrame) -> DataFrame:
    """(o_custkey, day, last_key, ends): is there no order in the 180 days after a day?

    The next order is looked up among distinct order days of an account, so an
    account with a third of all orders still is one window of calendar length.
    """
    days = orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(
        F.max("o_orderkey").alias("last_key"))
    following = F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day"))
    gap = F.datediff(following, "day")
    return days.withColumn("ends", F.coalesce(gap > CHURN_DAYS, F.lit(True)))


_ADD_ONS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
_CONTRACTS = {"1-URGENT": "Month-to-month", "2-HIGH": "Month-to-month", "3-MEDIUM": "One year",
              "4-NOT SPECIFIED": "Two year"}
_INTERNET = {"F": "Fiber optic", "O": "DSL", "P": "No"}
_PAYMENT = {"AUTOMOBILE": "Electronic check", "BUILDING": "Mailed check",
            "FURNITURE": "Bank transfer (automatic)", "HOUSEHOLD": "Credit card (automatic)"}


_ACCOUNT_COLUMNS = {"SeniorCitizen", "Partner", "Dependents", "PaymentMethod"}


def _mapped(column: str, names: dict[str, str], other: str | None = None):
    chain = F
    for key, value in names.items():
        chain = chain.when(F.col(column) == key, value)
    return chain.otherwise(F.lit(other))


def customers(spark: SparkSession, sf: str, churn: bool = False, dirty: bool = False,
              accounts: bool = True) -> DataFrame:
    """One subscription per order with the columns of the customer contract.

    ``churn`` adds the label, ``dirty`` blanks some totals and spoils some labels.
    Without ``accounts`` the columns of the account, and its join, are left out.
    """
    def answer(condition):
        return F.when(condition, "Yes").otherwise("No")

    orders = table(spark, sf, "orders").withColumns({
        "_k": F.col("o_orderkey"), "day": F.to_date("o_orderdate")})
    rows = orders
    if accounts:
        holders = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        rows = orders.join(holders, orders.o_custkey == holders.c_custkey, "left")
    if churn:
        rows = rows.join(order_days(table(spark, sf, "orders")), ["o_custkey", "day"])
    tenure = F.expr("CAST(datediff(DATE'2001-08-01', to_date(o_orderdate)) DIV 30 AS INT)")
    monthly = F.col("o_totalprice") / 5000.0
    phone, online = F.expr("(_k DIV 2) % 10 > 0"), F.col("o_orderstatus") != "P"
    columns = {
        "customerID": F.col("_k").cast("string"),
        "account_id": F.col("o_custkey"),
        "gender": F.when(F.col("o_custkey") % 2 == 0, "Female").otherwise("Male"),
        "SeniorCitizen": F.coalesce((F.col("c_nationkey") % 5 == 0).cast("int"), F.lit(0)),
        "Partner": answer(F.col("c_acctbal") > 4500),
        "Dependents": answer(F.col("c_nationkey") < 10),
        "tenure": tenure,
        "PhoneService": answer(phone),
        "MultipleLines": F.when(~phone, "No phone service").otherwise(answer(F.col("_k") % 3 == 0)),
        "InternetService": _mapped("o_orderstatus", _INTERNET),
        **{name: F.when(~online, "No internet service").otherwise(answer(F.expr(f"(_k DIV {i + 3}) % 2 = 0")))
           for i, name in enumerate(_ADD_ONS)},
        "Contract": _mapped("o_orderpriority", _CONTRACTS),
        "PaperlessBilling": answer(F.expr("(_k DIV 5) % 2 = 0")),
        "PaymentMethod": _mapped("c_mktsegment", _PAYMENT, "Gift card"),
        "MonthlyCharges": monthly,
        "TotalCharges": F.when(F.col("_k") % 97 == 0, " ").when(F.col("_k") % 89 == 0, "n/a").otherwise(
            F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" "))) if dirty else tenure * monthly,
    }
    if churn:
        churned = (F.col("_k") == F.col("last_key")) & F.col("ends")
        label = answer(churned)
        columns["Churn"] = (
            F.when(F.col("_k") % 101 == 0, F.lit(None)).when(F.col("_k") % 103 == 0, "Maybe").otherwise(label)
            if dirty else churned.cast("int"))
    if not accounts:
        columns = {n: c for n, c in columns.items() if n not in _ACCOUNT_COLUMNS}
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def _case(column: str, names: dict[str, str], other: str = "NULL") -> str:
    return " ".join(["CASE", *[f"WHEN {column} = '{k}' THEN '{v}'" for k, v in names.items()], f"ELSE {other} END"])


_ADD_ON_SQL = ",\n    ".join(
    f"CASE WHEN o_orderstatus = 'P' THEN 'No internet service' WHEN (o_orderkey // {i + 3}) % 2 = 0 THEN 'Yes' "
    f"ELSE 'No' END AS \"{name}\"" for i, name in enumerate(_ADD_ONS))

CUSTOMERS = f"""
customers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS "customerID", o_orderkey AS k, o_custkey AS account_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CAST(coalesce(c_nationkey % 5 = 0, false) AS INT) AS "SeniorCitizen",
    CASE WHEN c_acctbal > 4500 THEN 'Yes' ELSE 'No' END AS "Partner",
    CASE WHEN c_nationkey < 10 THEN 'Yes' ELSE 'No' END AS "Dependents",
    CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') // 30 AS INT) AS tenure,
    CASE WHEN (o_orderkey // 2) % 10 > 0 THEN 'Yes' ELSE 'No' END AS "PhoneService",
    CASE WHEN (o_orderkey // 2) % 10 = 0 THEN 'No phone service' WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'No' END
      AS "MultipleLines",
    {_case("o_orderstatus", _INTERNET)} AS "InternetService",
    {_ADD_ON_SQL},
    {_case("o_orderpriority", _CONTRACTS)} AS "Contract",
    CASE WHEN (o_orderkey // 5) % 2 = 0 THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
    {_case("c_mktsegment", _PAYMENT, "'Gift card'")} AS "PaymentMethod",
    o_totalprice / 5000.0::DOUBLE AS "MonthlyCharges",
    (date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') // 30) * (o_totalprice / 5000.0::DOUBLE)
      AS "TotalCharges", o_totalprice,
    CASE WHEN lead(o_orderdate) OVER w IS NULL
      OR date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER w AS DATE)) > {CHURN_DAYS}
      THEN 1 ELSE 0 END AS "Churn"
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)"""

SCORED = CUSTOMERS + """,
scored AS (
  SELECT *, least(0.96::DOUBLE, greatest(0.04::DOUBLE, 0.15::DOUBLE
    + CASE WHEN "Contract" = 'Month-to-month' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN tenure <= 6 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN "InternetService" = 'Fiber optic' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END)) AS p
  FROM customers
)"""


def scored_customers(spark: SparkSession, sf: str, churn: bool = False) -> DataFrame:
    return scoring.scored(customers(spark, sf, churn, accounts=False))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("CustomerId")).agg(
        (F.count("*") % 551 + 300).cast("int").alias("CreditScore"),
        (F.min("value") * 1000.0).alias("Balance"),
        F.size(F.collect_set("event_type")).alias("NumOfProducts"),
        (F.max("value") * 1000.0).alias("EstimatedSalary"),
    )


BANK = """
bank AS (
  SELECT CAST(user_id AS VARCHAR) AS "CustomerId", CAST(count(*) % 551 + 300 AS INT) AS "CreditScore",
    min(value) * 1000.0::DOUBLE AS "Balance", CAST(count(DISTINCT event_type) AS INT) AS "NumOfProducts",
    max(value) * 1000.0::DOUBLE AS "EstimatedSalary"
  FROM events GROUP BY user_id
)"""


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select(
        F.col("conv_id").cast("string").alias("customerID"), "turn", F.col("text").alias("Ticket Description"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get_json_object("props", "$.k").try_cast("int") % 4
    return table(spark, sf, "events").where("event_type IN ('purchase', 'error')").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("customer_id"),
        F.concat(F.lit("offer-"), F.coalesce(kind.cast("string"), F.lit("none"))).alias("intervention_type"),
        (F.col("event_type") == "purchase").cast("int").alias("outcome"), F.col("ts").alias("timestamp"))


OUTCOMES = """
outcomes AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS customer_id,
    'offer-' || coalesce(CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 4 AS VARCHAR), 'none')
      AS intervention_type,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS outcome, ts AS "timestamp"
  FROM events WHERE event_type IN ('purchase', 'error')
)"""


def graded_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with two scores, so that two models can be compared."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    p = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), p.alias("p"), (1.0 - p).alias("q"))


GRADED = """
graded AS (
  SELECT doc_id, quality AS y, n_chars / (n_chars + 2000.0::DOUBLE) AS p,
    1.0::DOUBLE - n_chars / (n_chars + 2000.0::DOUBLE) AS q
  FROM labels JOIN documents USING (doc_id)
)"""


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(words: list[str]) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains(low, w))) > 0"


def _hits(words: list[str]) -> str:
    return f"least(5, len(list_filter({sql_list(words)}, lambda w: contains(low, w))))"


def text_features_sql(source: str, keys: str, text: str = "text", name: str = "featured") -> str:
    """CTE ``featured`` with the four text features, by list functions instead of boolean chains."""
    lex = LEXICON
    topics = ", ".join(f"CASE WHEN {_any(w)} THEN '{t}' END" for t, w in lex.topics.items())
    return f"""
{name} AS (
  SELECT {keys}, low, topics,
    CASE WHEN low IS NULL THEN [] WHEN len(topics) = 0 THEN ['other'] ELSE topics END AS complaint_topics,
    CASE WHEN {_any(lex.urgency["critical"])} THEN 'critical' WHEN {_any(lex.urgency["fault"])} THEN 'high'
      WHEN {_any(lex.urgency["question"])} THEN 'medium' WHEN {_any(lex.urgency["hurry"])} THEN 'high'
      ELSE 'low' END AS urgency_level,
    greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE
      WHEN {_hits(lex.negative)} > 0 THEN -0.5::DOUBLE - 0.1::DOUBLE * {_hits(lex.negative)}
      WHEN {_hits(lex.positive)} > 0 THEN 0.3::DOUBLE + 0.1::DOUBLE * {_hits(lex.positive)}
      ELSE 0.0::DOUBLE END)) AS sentiment_score,
    CASE WHEN {_any(lex.escalation)} THEN 1 ELSE 0 END AS escalation_flag
  FROM (SELECT *, list_filter([{topics}], lambda t: t IS NOT NULL) AS topics
        FROM (SELECT *, lower({text}) AS low FROM {source}))
)"""
