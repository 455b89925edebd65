"""Snapshot, training and scoring jobs from files to answers."""

import random

import pytest
from pyspark.sql import functions as F

from keepwell.functions import text as T, values as V
from keepwell.operators import corpus, quality, training
from keepwell.plans import jobs
from keepwell.sources import tables
from test_text import CASES
from test_texts_and_answers import PLAYBOOK

CUSTOMER_HEADER = ("customerID,gender,SeniorCitizen,Partner,Dependents,tenure,PhoneService,MultipleLines,InternetService,"
                   "OnlineSecurity,OnlineBackup,DeviceProtection,TechSupport,StreamingTV,StreamingMovies,Contract,"
                   "PaperlessBilling,PaymentMethod,MonthlyCharges,TotalCharges,Churn")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, pick = tmp_path_factory.mktemp("raw"), random.Random(1)
    lines, people = [CUSTOMER_HEADER], [f"c{i:03d}" for i in range(160)]
    for i, person in enumerate(people):
        tenure, contract = pick.randint(0, 72), pick.choice(["Month-to-month", "One year", "Two year"])
        leaves = contract == "Month-to-month" and tenure < 30 or pick.random() < 0.1
        yn = lambda: pick.choice(["Yes", "No"])
        lines.append(",".join(map(str, [
            person, pick.choice(["Male", "Female"]), pick.randint(0, 1), yn(), yn(), tenure, yn(), yn(),
            pick.choice(["DSL", "Fiber optic", "No"]), yn(), yn(), "No internet service", yn(), yn(), yn(), contract, yn(),
            pick.choice(V.CATEGORY_VALUES["PaymentMethod"]), round(pick.uniform(20, 120), 2),
            " " if tenure == 0 else round(tenure * 50.0, 2), "Yes" if leaves else "No"])))
    lines.append(lines[1])
    (folder / "customers.csv").write_text("\n".join(lines) + "\n")
    bank = ["RowNumber,CustomerId,Surname,CreditScore,Geography,Gender,Age,Tenure,Balance,NumOfProducts,HasCrCard,"
            "IsActiveMember,EstimatedSalary,Exited"]
    bank += [f"{i},{p},S,{pick.randint(350, 850)},X,Male,40,3,{pick.randint(0, 90000)},{pick.randint(1, 4)},1,1,{pick.randint(1, 9) * 10000},0"
             for i, p in enumerate(people[:120])]
    (folder / "bank.csv").write_text("\n".join(bank) + "\n")
    ticket = ["Ticket ID,Ticket Subject,Ticket Description,Ticket Priority,Product Purchased,customerID"]
    ticket += [f't{i},s,"{body}",Low,TV,{people[i * 3]}' for i, (body, *_) in enumerate(CASES) if body and '"' not in body]
    (folder / "tickets.csv").write_text("\n".join(ticket) + "\n")
    return {n: str(folder / f"{n}.csv") for n in ("customers", "bank", "tickets")}


@pytest.fixture(scope="module")
def store(spark, files, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    jobs.build_snapshot(spark, files, root, "2024-03-01")
    return root


def test_snapshot_has_all_groups_and_a_manifest(spark, store, files):
    snapshot = tables.read_snapshot(spark, store, "2024-03-01")
    assert snapshot.count() == 160 and set(snapshot.columns) >= {c for g in V.GROUP_COLUMNS.values() for c in g}
    assert snapshot.where("CreditScore IS NULL OR TotalCharges IS NULL").count() == 0
    row = spark.read.json(f"{store}/manifest").first()
    assert (row.row_count, row.status, row.snapshot_date) == (160, "PASSED", "2024-03-01")


def test_a_leaking_snapshot_is_not_written(spark, files, tmp_path):
    leak = tables.read_source(spark, files["customers"], jobs.contracts.CUSTOMERS, keep_corrupt=False).dropDuplicates(
        ["customerID"]).select("customerID", (F.col("Churn") == "Yes").cast("double").alias("days_since_last_login"))
    with pytest.raises(quality.QualityError, match="target_leakage: days_since_last_login"):
        jobs.build_snapshot(spark, files, str(tmp_path / "s"), "2024-03-01", activity_features=leak)
    with pytest.raises(FileNotFoundError):
        tables.read_snapshot(spark, str(tmp_path / "s"), "2024-03-01")


def test_seeded_jitter_stays_within_the_bank_range(spark, files, tmp_path):
    snapshot = jobs.build_snapshot(spark, files, str(tmp_path / "s"), "2024-03-01", jitter_seed="42")
    r = snapshot.agg(F.min("CreditScore").alias("low"), F.max("CreditScore").alias("high"),
                     F.countDistinct("Balance").alias("n")).first()
    assert 350 <= r.low and r.high <= 850 and r.n > 120


def test_train_score_and_brief(spark, store):
    snapshot = tables.read_snapshot(spark, store, "2024-03-01")
    params = training.BoostedParams(trees=4, depth=3, rate=0.3)
    weights = snapshot.select("customerID", F.lit(2.0).alias("weight")).limit(10)
    trained = jobs.train(snapshot, params, weights)
    assert 0.10 <= trained.threshold <= 0.89
    report = trained.metrics.first()
    assert report.roc_auc > 0.6 and 0 <= report.recall <= 1
    scores = jobs.score_snapshot(trained, snapshot).cache()
    rows = scores.collect()
    assert len(rows) == 160 and all(len(r.top_drivers) == 3 and 0 <= r.churn_score <= 1 for r in rows)

    sections = corpus.sections(spark.createDataFrame([("p", PLAYBOOK)], "path string, text string"), "path", "text")
    latest = spark.createDataFrame([("c000", "offer", 1)], "customerID string, intervention_type string, outcome int")
    documents = corpus.corpus(sections, corpus.cases(jobs.features.model_inputs(snapshot), latest))
    assert documents.where("kind = 'section'").count() == 2
    embedding = corpus.fit_embedding(documents)
    told = jobs.briefings(scores, snapshot, documents, embedding, trained.threshold).collect()
    assert len(told) == 160
    for r in told:
        quiet = r.recommended_action == jobs.render.NO_ACTION
        assert quiet == (r.churn_score < trained.threshold)
    assert scores.where(F.col("churn_score") >= trained.threshold).count() > 0


def test_retraining_runs_records_and_promotes(spark, store, tmp_path):
    snapshot = tables.read_snapshot(spark, store, "2024-03-01")
    root, params = str(tmp_path / "models"), training.BoostedParams(trees=3, depth=3, rate=0.3)
    log = spark.createDataFrame([("c000", 1, 5), ("c001", 0, 6)], "customer_id string, outcome int, id long").withColumn(
        "timestamp", F.lit("2024-02-01").cast("timestamp_ntz"))
    decay = spark.createDataFrame([(0,)], "alert int")
    calm = spark.createDataFrame([("tenure", 0.01)], "feature string, psi double")
    drifted = spark.createDataFrame([("tenure", 0.9)], "feature string, psi double")
    assert jobs.retrain(snapshot, calm, decay, log, root, "2024-04-01", params).first().fired == 0
    first = jobs.retrain(snapshot, drifted, decay, log, root, "2024-04-02", params).first()
    assert (first.fired, first.n_drifted, first.promoted) == (1, 1, 1) and first.roc_auc > 0.5
    kept = jobs.load_trained(spark, f"{root}/production")
    assert kept.threshold == first.threshold and kept.metrics.first().roc_auc == first.roc_auc
    scores = jobs.score_snapshot(kept, snapshot)
    assert scores.count() == 160 and scores.where("churn_score BETWEEN 0 AND 1").count() == 160
    again = jobs.retrain(snapshot, drifted, decay, log, root, "2024-04-03", params).first()
    assert again.promoted == int(again.roc_auc >= first.roc_auc - V.PROMOTION_MARGIN)
    assert spark.read.json(f"{root}/retraining").count() == 3
    assert spark.read.json(f"{root}/runs/2024-04-02/thresholds").first().threshold == first.threshold
    assert 1 <= spark.read.json(f"{root}/runs/2024-04-02/importances").count() <= 15
