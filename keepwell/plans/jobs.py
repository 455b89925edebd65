"""Whole jobs: build a snapshot, train on it, score requests against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from keepwell.functions import features, render, scoring, text as T, values as V
from keepwell.operators import (
    corpus, drift, events as activity, explain, impute, metrics, neighbours, outcomes, prepare, quality, sampling, tickets,
    training,
)
from keepwell.session import settle
from keepwell.sources import contracts, tables

ORDER = "ingest_place"
NEIGHBOURS = 10
HIT_CAPS = {"section": 1, "case": 5}


def cleaned_customers(raw: DataFrame, order: str = ORDER) -> DataFrame:
    """Totals as numbers, one row per customer, labelled rows only, in this order:
    a first row with a bad label removes the customer."""
    unique = quality.keep_first(quality.coerce_totals(raw), "customerID", [order]).drop("n_dups", order)
    return quality.keep_labelled(unique, "Churn")


def customer_features(customers: DataFrame, bank: DataFrame, ticket_rows: DataFrame, *,
                      activity_features: DataFrame | None = None, market_features: DataFrame | None = None,
                      lexicon: T.Lexicon = T.DEFAULT_LEXICON, jitter_seed: str | None = None) -> DataFrame:
    """One row per customer with every column of the five groups.

    ``activity_features`` and ``market_features`` hold one row per customerID; what
    they do not give takes the scoring defaults.
    """
    joined = impute.impute(
        impute.enrich_from_bank(customers, bank), impute.column_statistics(bank, V.BANK_COLUMNS),
        V.BANK_COLUMNS, jitter_seed=jitter_seed)
    ready = features.billing_features(features.encode_customers(joined)).withColumn(
        "service_bundle_size", features.bundle_size())
    rolled = tickets.rollup(tickets.with_text_features(ticket_rows, lexicon=lexicon))
    ready = tickets.fill_missing_tickets(ready, rolled)
    extra = [t for t in (activity_features, market_features) if t is not None]
    ready = activity.join_features(ready, extra)
    wanted = {c for columns in V.GROUP_COLUMNS.values() for c in columns} & set(V.SCORING_DEFAULTS)
    return ready.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(V.SCORING_DEFAULTS[c])) if c in ready.columns else F.lit(V.SCORING_DEFAULTS[c])
           for c in sorted(wanted) if c not in ready.columns or c in
           {name for t in extra for name in t.columns}},
        "tenure_band": features.stored_tenure_band(F.col("tenure")),
    })


def build_snapshot(spark: SparkSession, paths: dict[str, str], root: str, snapshot_date: str,
                   exempt: list[str] | None = None, buckets: int | None = None, **options) -> DataFrame:
    """Reads, checks and writes one snapshot; its commit and then the manifest row come last.

    ``paths`` names the customers, bank and tickets files. Raises with all findings
    when a gate fails, before anything but the failed run's manifest row is written.
    """
    raw = {name: tables.read_source(spark, paths[name], contract, keep_corrupt=False, order=ORDER)
           for name, contract in (("customers", contracts.CUSTOMERS), ("bank", contracts.BANK),
                                  ("tickets", contracts.TICKETS))}
    bank = quality.keep_first(raw["bank"], "CustomerId", [ORDER]).drop("n_dups", ORDER)
    customers = cleaned_customers(raw["customers"])
    snapshot = settle(customer_features(customers, bank, raw["tickets"].drop(ORDER), **options), "candidate")
    # columns without a source hold one default value, which is no finding
    constant = [c for c in V.SCORING_DEFAULTS if not any(
        c in t.columns for t in (options.get("activity_features"), options.get("market_features")) if t is not None)
        and c not in _MEASURED]
    exempted = sorted({*V.CONSTANT_BY_DESIGN, *constant, *(exempt or [])})
    try:
        quality.require_quality(snapshot, "Churn", exempted)
    except quality.QualityError:
        tables.append_json(tables.manifest(snapshot, snapshot_date, paths, "FAILED"), f"{root}/manifest")
        raise
    tables.write_groups(snapshot, root, snapshot_date, buckets=buckets)
    tables.append_json(tables.manifest(snapshot, snapshot_date, paths), f"{root}/manifest")
    return snapshot


_MEASURED = {
    "tenure", "MonthlyCharges", "TotalCharges", "CreditScore", "Balance", "NumOfProducts", "EstimatedSalary",
    "SeniorCitizen", "Partner", "Dependents", "PhoneService", "PaperlessBilling", "contract_type_encoded",
    "service_bundle_size", "sentiment_score", "escalation_flag", "charges_per_tenure_month", "is_high_risk_contract",
    "ticket_sentiment_score", "ticket_complaint_topics_billing", "ticket_complaint_topics_competitor",
    "ticket_complaint_topics_performance", "ticket_escalation_flag",
}


@dataclass
class Trained:
    model: object
    scaler: DataFrame
    categories: dict[str, list[str]]
    names: list[str]
    threshold: float
    metrics: DataFrame


def train(snapshot: DataFrame, params: training.BoostedParams = training.BoostedParams(),
          weights: DataFrame | None = None, key: str = "customerID", name: str = "boosted") -> Trained:
    """Split, fit the preparation and the model on train, choose the threshold on a held-out
    fold of train, report on test. ``weights`` is (key, weight); oversampled rows weigh 1."""
    split = sampling.stratified_split(snapshot, "Churn", key)
    fit_rows = split.where("split = 'train'")
    scaler = settle(prepare.fit_scaler(fit_rows), "scaler")
    categories = prepare.fit_categories(fit_rows, list(V.CATEGORY_VALUES))
    names = [*V.SCALED_COLUMNS, *[f"{c}_{v}" for c, vs in categories.items() for v in vs], *V.PLAIN_COLUMNS]
    matrix = prepare.model_matrix(split, scaler, categories, names).select(key, "Churn", "split", "features")
    if weights is not None:
        matrix = matrix.join(weights.select(key, "weight"), key, "left").na.fill(1.0, ["weight"])
    matrix = settle(matrix, "matrix")
    learn = sampling.stratified_folds(matrix.where("split = 'train'").drop("split"), "Churn", key, 5)
    weight = "weight" if weights is not None else None
    balanced = settle(sampling.balanced(learn.where("fold > 0").drop("fold"), "Churn", key, weight=weight), "balanced")
    model = training.fit_boosted(balanced, params, weight=weight)
    checked = training.scored(model, learn.where("fold = 0"))
    best = metrics.cost_curve(checked, "Churn", "churn_score").where("is_best = 1").first()
    report = training.evaluate(model, name, matrix.where("split = 'test'"), threshold=best["threshold"])
    return Trained(model, scaler, categories, names, best["threshold"], report)


def save_trained(trained: Trained, path: str) -> None:
    """The model with all that scoring needs: scaler, categories, names, threshold, report."""
    spark = trained.scaler.sparkSession
    trained.model.write().overwrite().save(f"{path}/model")
    trained.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/report")
    spark.createDataFrame([(trained.categories, trained.names, trained.threshold)],
                          "categories map<string,array<string>>, names array<string>, threshold double") \
        .write.mode("overwrite").parquet(f"{path}/settings")


def load_trained(spark: SparkSession, path: str) -> Trained:
    settings = spark.read.parquet(f"{path}/settings").first()
    return Trained(GBTClassificationModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scaler"),
                   dict(settings.categories), list(settings.names), settings.threshold, spark.read.parquet(f"{path}/report"))


def record_training(trained: Trained, importances: DataFrame, root: str) -> None:
    """Appends the chosen threshold with the report, and writes the fifteen largest importances."""
    tables.append_json(trained.metrics.withColumn("threshold", F.lit(trained.threshold)), f"{root}/thresholds")
    explain.top_importances(importances).write.mode("overwrite").json(f"{root}/importances")


def driver_importances(trained: Trained, snapshot: DataFrame, key: str = "customerID") -> DataFrame:
    """(feature, importance_mean): mean absolute contribution over the snapshot."""
    matrix = prepare.model_matrix(snapshot, trained.scaler, trained.categories, trained.names).select(key, "features")
    explained, _ = explain.tree_contributions(matrix, trained.model, trained.names)
    return explain.global_importance(explained).withColumnRenamed("mean_abs", "importance_mean")


def retrain(snapshot: DataFrame, psi: DataFrame, decay: DataFrame, outcome_log: DataFrame, root: str, run_date: str,
            params: training.BoostedParams = training.RETRAIN_PARAMS, key: str = "customerID") -> DataFrame:
    """Trigger, weights, training, comparison, gate, record. Returns the run's one-row record.

    The candidate is trained on customers weighed by their last logged outcome and
    compared with the model stored below ``root``, if there is one, on the report of
    its own test part. It replaces that model only if the safety gate holds.
    """
    spark = snapshot.sparkSession
    fired = drift.retrain_trigger(psi, decay).first()
    cells = {"run_date": run_date, "n_drifted": fired.n_drifted, "decayed": fired.decayed, "fired": fired.fire,
             "roc_auc": None, "threshold": None, "promoted": 0}
    if fired.fire:
        weights = outcomes.sample_weights(snapshot.select(key), outcome_log, key)
        candidate = train(snapshot, params, weights, key, name="candidate")
        report = settle(candidate.metrics, "candidate-report")
        current = f"{root}/production"
        known = tables.exists(spark, f"{current}/report")
        compared = report
        if known:
            compared = report.unionByName(spark.read.parquet(f"{current}/report").withColumn("model", F.lit("production")))
        gate = metrics.promotion_gate(compared, "model", "production" if known else None).where("model = 'candidate'").first()
        cells |= {"roc_auc": gate.roc_auc, "threshold": candidate.threshold, "promoted": gate.safety_ok}
        record_training(candidate, driver_importances(candidate, snapshot, key), f"{root}/runs/{run_date}")
        if gate.safety_ok:
            candidate.metrics = report
            save_trained(candidate, current)
    row = spark.createDataFrame([tuple(cells.values())], "run_date string, n_drifted long, decayed int, fired int, "
                                "roc_auc double, threshold double, promoted int")
    tables.append_json(row, f"{root}/retraining")
    return row


def score_snapshot(trained: Trained, snapshot: DataFrame, key: str = "customerID") -> DataFrame:
    """(key, churn_score, risk_level, top_drivers) for every customer."""
    matrix = prepare.model_matrix(snapshot, trained.scaler, trained.categories, trained.names).select(key, "features")
    explained, _ = explain.tree_contributions(matrix, trained.model, trained.names)
    return training.scored(trained.model, explained).select(
        key, "churn_score",
        scoring.confidence(F.col("churn_score"), trained.threshold).alias("confidence"),
        scoring.risk_level(F.col("churn_score"), trained.threshold).alias("risk_level"),
        explain.top_drivers(F.col("contributions")).alias("top_drivers"))


def briefings(scores: DataFrame, customers: DataFrame, documents: DataFrame, embedding: PipelineModel,
              threshold: float = V.DECISION_THRESHOLD, key: str = "customerID") -> DataFrame:
    """(key, recommended_action) for scored customers.

    Only customers at or above the threshold are searched for. ``documents`` is
    (doc_id, kind, text), the sections and all cases; ``nearest`` carries them to the
    customers if their size allows, else both sides meet cell by cell.
    """
    rows = scores.select(key, "churn_score", "top_drivers").join(features.model_inputs(customers), key)
    asked = render.with_query_text(rows.where(F.col("churn_score") >= F.lit(threshold)), output="text").select(
        key, "text")
    vectors = corpus.embed(documents, embedding)
    hits = neighbours.nearest(corpus.embed(asked, embedding), vectors, NEIGHBOURS, key, "doc_id")
    kinds = documents.select(F.col("doc_id").alias("neighbour_id"), "kind", F.col("text").alias("section"))
    section = neighbours.cap_by_kind(hits, kinds, HIT_CAPS).where("kind = 'section'").select(
        F.col("query_id").alias(key), "section")
    answers = asked.join(section, key, "left").select(
        key, render.briefing(F.col("text"), F.col("section")).alias("_answer"))
    return scores.select(key, "churn_score").join(answers, key, "left").select(
        key, "churn_score", F.coalesce("_answer", F.lit(render.NO_ACTION)).alias("recommended_action"))
