"""What is written and read again: snapshots by date, the outcome log, prediction files, typed contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.functions import features, text as T
from keepwell.plans import views as D
from keepwell.plans.registry import query
from keepwell.session import scratch_path
from keepwell.sources import contracts, snapshots, tables

_TWO_GROUPS = {"who": ["customerID", "tenure"], "terms": ["customerID", "Contract"]}


@query("snapshot_of_date", f"""WITH {D.CUSTOMERS} SELECT "customerID", tenure, "Contract" FROM customers""")
def snapshot_of_date(spark, sf):
    """Two dated snapshots are written, one of them twice; the first is read."""
    rows = D.customers(spark, sf, accounts=False).select("customerID", "tenure", "Contract")
    later = rows.withColumn("tenure", F.col("tenure") + 1)
    root = scratch_path(spark, "snapshots")
    for table, day in ((later, "2024-03-01"), (rows, "2024-03-01"), (later, "2024-04-01")):
        tables.write_groups(table, root, day, _TWO_GROUPS)
    return tables.read_snapshot(spark, root, "2024-03-01", list(_TWO_GROUPS))


@query("snapshot_as_committed", f"""WITH {D.CUSTOMERS}
SELECT '2024-03-01' AS day, 1 AS version, false AS latest, "customerID", tenure, "Contract" FROM customers
UNION ALL SELECT '2024-03-01', 2, true, "customerID", tenure + 1, "Contract" FROM customers""")
def snapshot_as_committed(spark, sf):
    """Two versions of one date, a third one and another date whose writers stopped before their commit: what readers find."""
    rows = D.customers(spark, sf, accounts=False).select("customerID", "tenure", "Contract")
    root = scratch_path(spark, "commits")
    for more in (0, 1):
        snapshots.write_groups(rows.withColumn("tenure", F.col("tenure") + more), root, "2024-03-01", _TWO_GROUPS)
    for day in ("2024-03-01", "2024-04-01"):
        snapshots.write_files(rows.withColumn("tenure", F.lit(-1)), root, day, _TWO_GROUPS)
    found = None
    for entry in snapshots.commits(spark, root).orderBy("snapshot_date", "version").collect():  # one per version
        day, version = entry.snapshot_date, entry.version
        latest = version == snapshots.versions(spark, root, day)[-1]
        read = snapshots.read_snapshot(spark, root, day, list(_TWO_GROUPS), None if latest else version)
        read = read.select(F.lit(day).alias("day"), F.lit(version).alias("version"), F.lit(latest).alias("latest"), *read.columns)
        found = read if found is None else found.unionByName(read)
    return found


@query("outcome_log", f"""WITH {D.OUTCOMES}
SELECT customer_id, intervention_type, outcome, count(*) AS n FROM outcomes GROUP BY ALL""")
def outcome_log(spark, sf):
    """Outcomes logged under new ids and read back; every row has an id of its own."""
    path = scratch_path(spark, "outcome-log")
    tables.append_outcomes(D.outcomes(spark, sf), path)
    log = tables.read_outcomes(spark, path).where("timestamp IS NOT NULL")
    return log.groupBy("customer_id", "intervention_type", "outcome").agg(F.count_distinct("id").alias("n"))


@query("prediction_file", f"""WITH {D.SCORED}
SELECT "customerID", CASE WHEN p >= 0.32::DOUBLE THEN 'High Risk' ELSE 'Low Risk' END AS risk_level,
  coalesce("Contract", 'none') || ', ' || coalesce("InternetService", 'none') AS drivers FROM scored""")
def prediction_file(spark, sf):
    """Predictions as a CSV file with a header; the list becomes text."""
    scored = D.scored_customers(spark, sf)
    named = F.array(*[F.coalesce(F.col(c), F.lit("none")) for c in ("Contract", "InternetService")])
    path = scratch_path(spark, "predictions")
    tables.write_csv(scored.select("customerID", "risk_level", named.alias("drivers")), path)
    return spark.read.schema("customerID string, risk_level string, drivers string").option("header", True).csv(path)


@query("contract_type_breaks", f"""WITH {D.CUSTOMERS},
told AS (SELECT CASE WHEN k % 89 = 0 THEN 'n/a' WHEN k % 97 = 0 THEN '1.5' ELSE tenure::VARCHAR END AS months FROM customers)
SELECT 'months' AS column_name, 'type' AS rule, count(*) FILTER (months IN ('n/a', '1.5')) AS n_bad FROM told
UNION ALL SELECT 'months', 'maximum', count(*) FILTER (try_cast(months AS DOUBLE) > 60) FROM told""")
def contract_type_breaks(spark, sf):
    """Numbers delivered as text: words and fractions break the integer rule."""
    contract = contracts.Contract("months", (contracts.ColumnRule("months", "integer", True, (), None, 60),), ())
    key = F.col("customerID").cast("long")
    rows = D.customers(spark, sf, accounts=False).select(
        F.when(key % 89 == 0, "n/a").when(key % 97 == 0, "1.5").otherwise(F.col("tenure").cast("string")).alias("months"))
    return contracts.violations(rows, contract)


_MONTHS = """{"title": "months", "required": ["customerID", "tenure"], "properties": {
  "customerID": {"type": "string"}, "tenure": {"type": "integer"}, "MonthlyCharges": {"type": ["number", "null"]}}}"""


@query("csv_source_typed", f"""WITH {D.CUSTOMERS}
SELECT "customerID", CASE WHEN k % 89 > 0 THEN tenure END AS tenure, "Contract", round("MonthlyCharges", 6) AS "MonthlyCharges",
  CASE WHEN k % 89 = 0 THEN 1 ELSE 0 END AS broken FROM customers""")
def csv_source_typed(spark, sf):
    """A CSV source written, then read under a JSON contract that does not know one of its columns; some rows do not parse."""
    rows = D.customers(spark, sf, accounts=False)
    months = F.when(F.col("customerID").cast("long") % 89 == 0, "n/a").otherwise(F.col("tenure").cast("string"))
    path = scratch_path(spark, "source")
    tables.write_csv(rows.select("Contract", "customerID", months.alias("tenure"), "MonthlyCharges"), path)
    found = tables.read_source(spark, path, contracts.load_contract(_MONTHS))
    return found.select("customerID", "tenure", "Contract", F.round("MonthlyCharges", 6).alias("MonthlyCharges"),
                        F.col(tables.CORRUPT).isNotNull().cast("int").alias("broken"))


_TURNS = D.text_features_sql("documents", "doc_id")


@query("urgency_encoded", f"""WITH {_TURNS}
SELECT doc_id, CASE urgency_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END
  AS urgency_level_encoded FROM featured""")
def urgency_encoded(spark, sf):
    rows = T.with_features(D.table(spark, sf, "documents"), "text", D.LEXICON).select("doc_id", "urgency_level")
    return features.model_inputs(rows).select("doc_id", "urgency_level_encoded")
