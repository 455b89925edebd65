"""Streams give what the batch gives, across several input files and restarts."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from keepwell.functions import scoring, text as T
from keepwell.operators.tickets import with_text_features
from keepwell.plans import views as D
from keepwell.session import settle, shared_folder
from keepwell.streaming import jobs


@pytest.fixture()
def many_files(spark, tmp_path):
    path = str(tmp_path / "turns")
    D.tickets(spark, SF).repartition(5).write.parquet(path)
    return path


def stream(spark, path, **options):
    return jobs.read_files(spark, path, spark.read.parquet(path).schema, **options)


def test_ticket_stream_equals_batch(spark, many_files):
    done = jobs.run_available(jobs.ticket_features(stream(spark, many_files, files_per_batch=2), "Ticket Description"), "t")
    batch = with_text_features(spark.read.parquet(many_files))
    assert done.count() == batch.count() and done.exceptAll(batch).count() == 0


def test_outcomes_arrive_once_across_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(f"o{i}", f"c{i % 3}", 1, f"2024-01-01 00:{i:02d}:00") for i in range(20)],
                                 "id string, customer_id string, outcome int, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))
    for _ in range(3):
        rows.coalesce(1).write.mode("append").parquet(path)
    done = jobs.run_available(jobs.outcomes_once(stream(spark, path, files_per_batch=1)), "o")
    assert done.count() == 20 and done.select("id").distinct().count() == 20


def outcome_rows(spark, ids, day):
    return spark.createDataFrame([(f"o{i}", f"c{i % 3}", 1, f"2024-{day} 00:00:00") for i in ids],
                                 "id string, customer_id string, outcome int, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")).coalesce(1)


def test_outcomes_are_logged_once_however_late(spark, tmp_path):
    path, root = str(tmp_path / "in.parquet"), str(tmp_path / "log")
    outcome_rows(spark, range(9), "01-01").write.parquet(path)
    outcome_rows(spark, [7, 7, 9], "01-02").write.mode("append").parquet(path)
    outcome_rows(spark, [100], "01-02").write.parquet(path + "_old")
    assert jobs.log_outcomes(stream(spark, path, files_per_batch=1), root).count() == 10
    outcome_rows(spark, [0, 3, 10], "02-20").write.mode("append").parquet(path)
    log = jobs.log_outcomes(stream(spark, path, files_per_batch=1), root)
    assert sorted(r.id for r in log.collect()) == sorted(f"o{i}" for i in range(11))
    assert jobs.log_outcomes(stream(spark, path), root).count() == 11


def test_outcomes_without_identifier_are_all_kept(spark, tmp_path):
    path, root = str(tmp_path / "in.parquet"), str(tmp_path / "log")
    rows = outcome_rows(spark, range(3), "01-01")
    nameless = rows.withColumn("id", F.lit(None).cast("string"))
    rows.unionByName(nameless).unionByName(nameless.limit(1)).coalesce(1).write.parquet(path)
    assert jobs.log_outcomes(stream(spark, path), root).count() == 3
    assert jobs.rejected_outcomes(spark, root, rows.schema).count() == 4
    rows.unionByName(nameless).coalesce(1).write.mode("append").parquet(path)
    log = jobs.log_outcomes(stream(spark, path), root)
    assert sorted(r.id for r in log.collect()) == ["o0", "o1", "o2"]
    rejected = jobs.rejected_outcomes(spark, root, rows.schema).collect()
    assert len(rejected) == 7 and all(r.id is None and r.customer_id for r in rejected)


def test_known_outcomes_are_state_and_the_log_is_not_read(spark, tmp_path):
    path, root = str(tmp_path / "in.parquet"), str(tmp_path / "log")
    outcome_rows(spark, range(5), "01-01").write.parquet(path)
    assert jobs.log_outcomes(stream(spark, path), root).count() == 5
    outcome_rows(spark, range(4, 6), "01-02").write.mode("append").parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with jobs.state_on_disk(spark):
        query = (jobs.first_deliveries(stream(spark, path)).writeStream.format("parquet").option("path", f"{root}/accepted/out")
                 .option("checkpointLocation", f"{root}/accepted/progress").trigger(availableNow=True).start())
        query.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    plan = query._jsq.explainInternal(True)
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert "StreamingDeduplicate" in plan and scans and not [s for s in scans if root in s]
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 6 and any("rocksdb" in name for name in state["customMetrics"])
    assert spark.read.parquet(f"{root}/accepted/out").count() == 6


def test_a_named_run_resumes(spark, tmp_path):
    path, root = str(tmp_path / "in.parquet"), str(tmp_path / "run")
    outcome_rows(spark, range(4), "01-01").write.parquet(path)
    assert jobs.run_available(stream(spark, path), "r", root).count() == 4
    outcome_rows(spark, range(4, 6), "01-02").write.mode("append").parquet(path)
    assert jobs.run_available(stream(spark, path), "r", root).count() == 6
    assert jobs.run_available(stream(spark, path), "r", root).count() == 6


def test_late_events_are_dropped_and_open_windows_held(spark, tmp_path):
    path = str(tmp_path / "events")
    for days in (["2024-01-01", "2024-01-02"], ["2024-01-20"], ["2024-01-03", "2024-01-21"]):
        spark.createDataFrame([(1, f"{d} 12:00:00") for d in days], "u int, ts string").withColumn(
            "ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    done = jobs.run_available(jobs.login_windows(stream(spark, path), "u", "ts"), "w").collect()
    assert done and max(r.window_end for r in done).strftime("%Y-%m-%d") <= "2024-01-20"


def test_requests_use_the_snapshot_when_known(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.createDataFrame([("a", "Two year", 50, "DSL"), ("z", "Month-to-month", 1, "Fiber optic")],
                          "customerID string, Contract string, tenure int, InternetService string").write.parquet(path)
    snapshot = spark.createDataFrame([("a", "Month-to-month", 2, "DSL")],
                                     "customerID string, Contract string, tenure int, InternetService string")
    done = jobs.run_available(jobs.scored_requests(stream(spark, path), snapshot), "r")
    assert {r.customerID: round(r.churn_score, 6) for r in done.collect()} == {"a": 0.75, "z": 0.87}
    batch = scoring.scored(spark.read.parquet(path).where("customerID = 'z'"))
    assert done.where("customerID = 'z'").select(batch.columns).exceptAll(batch).count() == 0


def test_scratch_tables_live_in_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert settle(spark.range(3)).inputFiles()[0].startswith("file://" + shared_folder(spark))
