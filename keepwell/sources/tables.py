"""Tables in and out: CSV sources, snapshots, logs, caches, results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from keepwell.functions import text as T, values as V
from keepwell.functions.features import coded, decoded
from keepwell.operators.membership import maybe_member, membership
from keepwell.session import settle
from keepwell.sources.contracts import Contract, require_columns
from keepwell.sources.snapshots import join_groups, read_group, read_snapshot, write_groups  # noqa: F401

CORRUPT = "_corrupt_record"
OUTCOME_SCHEMA = "id string, customer_id string, intervention_type string, outcome int, timestamp timestamp"
PIPELINE_VERSION = "v1.0"
CHECKS_RUN = ["null_rate", "zero_variance", "target_leakage"]


def read_source(spark: SparkSession, path: str, contract: Contract, keep_corrupt: bool = True,
                order: str | None = None) -> DataFrame:
    """A CSV source typed by its contract, in one pass and without inference.

    Columns follow the file's own header; ones the contract does not know are
    read as text. Rows that do not parse keep their text in ``_corrupt_record``.
    A missing file and missing required columns both raise before any job runs.
    ``order`` names a column that holds each row's place: file, block, row.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    known = {f.name: f for f in contract.schema().fields}
    fields = [known.get(c, StructField(c, StringType())) for c in header]
    if keep_corrupt:
        fields.append(StructField(CORRUPT, StringType()))
    df = (
        spark.read.schema(StructType(fields)).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True)
        .option("multiLine", False).csv(path)
    )
    if order:
        df = df.withColumn(order, F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row")))
    return require_columns(df, contract)


def manifest(snapshot: DataFrame, snapshot_date: str, sources: dict[str, str], status: str | Column = "PASSED",
             reference: str = "N/A - Initial baseline snapshot") -> DataFrame:
    """One row that describes a run, passed or failed; what readers see is decided by the commits of ``snapshots``."""
    return snapshot.agg(F.count("*").alias("row_count")).select(
        F.lit(snapshot_date).alias("snapshot_date"), F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        "row_count", (status if isinstance(status, Column) else F.lit(status)).alias("status"),
        F.array(*[F.lit(c) for c in CHECKS_RUN]).alias("checks_run"), F.lit(reference).alias("psi_reference"),
        F.lit(json.dumps(sources)).alias("source_files"))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Predictions for download; list columns become comma-separated text."""
    flat = [F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_outcomes(spark: SparkSession, path: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """The outcome log from Parquet or, with options for a table, over JDBC."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.schema(OUTCOME_SCHEMA).parquet(path)


def as_outcomes(rows: DataFrame) -> DataFrame:
    """Requests (customer_id, intervention_type, outcome) with a new id and the time of logging."""
    return rows.select(
        F.expr("uuid()").alias("id"), F.col("customer_id").cast("string").alias("customer_id"),
        "intervention_type", F.col("outcome").cast("int").alias("outcome"),
        F.current_timestamp().alias("timestamp"))


def append_outcomes(rows: DataFrame, path: str) -> None:
    as_outcomes(rows).write.mode("append").parquet(path)


def update_text_cache(texts: DataFrame, column: str, path: str, version: int,
                      lexicon: T.Lexicon = T.DEFAULT_LEXICON) -> tuple[int, int]:
    """Adds features of texts whose hash the cache does not hold; returns (extracted, reused) distinct texts.

    Hashes alone are compared with the cache. A bit table of the missing ones, of
    bounded size, goes to the texts, so features are computed where a text lies and
    for the missing ones only; no text is shuffled. ``version`` orders the parts of the
    cache: a later one replaces an earlier one.
    """
    spark = texts.sparkSession
    hashed = texts.where(F.col(column).isNotNull()).select(T.content_hash(F.col(column)).alias("ticket_hash"), F.col(column).alias("text"))
    known = spark.createDataFrame([], "ticket_hash string")
    if exists(spark, path):
        known = spark.read.parquet(path).select("ticket_hash").distinct()
    asked = hashed.select("ticket_hash").distinct().join(known.withColumn("known", F.lit(True)), "ticket_hash", "left")
    asked = settle(asked, "asked-hashes")
    missing = asked.where("known is null").select("ticket_hash")
    rows = maybe_member(hashed, "ticket_hash", membership(missing, "ticket_hash"))
    fresh = distinct_text_features(rows, "text", lexicon).join(missing, "ticket_hash", "left_semi").select("ticket_hash", *_FEATURES)
    fresh.withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return missing.count(), asked.where("known").count()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def replace_in_cache(rows: DataFrame, path: str, version: int) -> None:
    """Stores features under their hashes again; readers see the highest version."""
    rows.select("ticket_hash", *_FEATURES).withColumn("version", F.lit(version)).write.mode("append").parquet(path)


_FEATURES = ["sentiment_score", "urgency_level", "complaint_topics", "escalation_flag"]


def read_text_cache(spark: SparkSession, path: str) -> DataFrame:
    """The latest features per hash: the highest version is found on two columns, then its row is taken."""
    cache = spark.read.parquet(path)
    latest = cache.groupBy("ticket_hash").agg(F.max("version").alias("version"))
    return cache.join(latest, ["ticket_hash", "version"]).select("ticket_hash", *_FEATURES)


def distinct_text_features(texts: DataFrame, column: str, lexicon: T.Lexicon = T.DEFAULT_LEXICON) -> DataFrame:
    """(ticket_hash, n_texts, features) per distinct stripped text.

    Equal texts have equal features, so the largest of each stands for all. As
    numbers they aggregate by hash without sorting, and a text copied a billion
    times is one small row per task.
    """
    known = [*lexicon.topics, "other"]
    rows = T.with_features(texts.select(F.col(column).alias("text")), "text", lexicon).select(
        T.content_hash(F.col("text")).alias("ticket_hash"), "sentiment_score",
        coded(F.col("urgency_level"), V.MODEL_URGENCY_CODES).alias("urgency"),
        sum((F.array_contains("complaint_topics", t).cast("int") * (1 << i) for i, t in enumerate(known)),
            F.lit(0)).alias("topics"),
        F.col("escalation_flag").cast("int").alias("escalation"))
    topic = [F.when(F.col("topics").bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(known)]
    return rows.groupBy("ticket_hash").agg(
        F.count("*").alias("n_texts"), *[F.max(c).alias(c) for c in rows.columns[1:]]
    ).select(
        "ticket_hash", "n_texts", "sentiment_score",
        decoded(F.col("urgency"), V.MODEL_URGENCY_CODES).alias("urgency_level"),
        F.array_compact(F.array(*topic)).alias("complaint_topics"), (F.col("escalation") == 1).alias("escalation_flag"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Playbook files as whole texts (path, text); splitting is ``corpus.sections``."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))
