"""The streaming forms of batch operators; the expressions are the same."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from keepwell.functions import scoring, text as T, values as V
from keepwell.operators.tickets import with_text_features
from keepwell.session import scratch_path


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table (one file or a folder) as a stream. Neighbours of a similar name are not read."""
    # files of any date are read, also when a run is taken up again
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d")
            .parquet(exact_name(path)))


def exact_name(path: str) -> str:
    """A pattern that matches nothing but ``path``; a stream takes a file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; the session zone is taken."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def login_windows(events: DataFrame, key: str, time: str, length: str = "7 days", slide: str = "1 day",
                  late: str = "1 day") -> DataFrame:
    """Events per user and sliding window; state is dropped a day after a window closes."""
    return (
        event_time(events, time).withWatermark(time, late)
        .groupBy(F.window(time, length, slide), key).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n")
    )


def ticket_features(tickets: DataFrame, column: str, lexicon: T.Lexicon = T.DEFAULT_LEXICON) -> DataFrame:
    return with_text_features(tickets, column, lexicon)


def outcomes_once(outcomes: DataFrame, key: str = "id", time: str = "timestamp", late: str = "1 day") -> DataFrame:
    """Each outcome once within the allowed lateness, in bounded state; ``log_outcomes`` has no such limit."""
    return event_time(outcomes, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def scored_requests(requests: DataFrame, snapshot: DataFrame, key: str = "customerID",
                    threshold: float = V.DECISION_THRESHOLD) -> DataFrame:
    """Requests joined to the static snapshot; known customers use their snapshot values."""
    shared = [c for c in snapshot.columns if c != key and c in requests.columns]
    extra = [c for c in snapshot.columns if c != key and c not in requests.columns]
    right = snapshot.select(key, F.lit(True).alias("_known"),
                            *[F.col(c).alias(f"_s_{c}") for c in shared], *extra)
    joined = requests.join(right, key, "left").withColumns({
        c: F.when(F.col("_known"), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in shared
    }).drop("_known", *[f"_s_{c}" for c in shared])
    return scoring.scored(joined, threshold)


def login_averages(windows: DataFrame, key: str, days: int) -> DataFrame:
    """Daily averages of closed windows of that many days, named as the batch features are."""
    return windows.withColumn(f"logins_{days}d_rolling_avg", F.col("n") / float(days)).drop("n")


def run_available(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns all that it has written below ``root``.

    A job that names the ``root`` of an earlier run goes on where that run stopped
    and writes every row once; without a name a new place in the shared folder is taken.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB on the executors; the session's own settings come back."""
    before = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    for name, value in STATE_ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def first_deliveries(outcomes: DataFrame, key: str = "id") -> DataFrame:
    """Each identifier's outcome once, for good: its key stays in state without expiry. Rows without one are left out."""
    return outcomes.where(F.col(key).isNotNull()).dropDuplicates([key])


def log_outcomes(outcomes: DataFrame, root: str, key: str = "id") -> DataFrame:
    """Adds each outcome to the log below ``root`` once, however late it is delivered again.

    The identifiers logged so far are keyed state on disk, not read back from the log: a
    batch costs what its own rows cost. Of copies that arrive in one batch, any one is
    logged. Rows without identifier cannot be told from redeliveries; all of them go to a
    table of their own, ``rejected_outcomes``. Both tables are written exactly once per
    row by the file sink, also when a run stops and is taken up again. Returns the log.
    """
    with state_on_disk(outcomes.sparkSession):
        log = run_available(first_deliveries(outcomes, key), "outcomes", f"{root}/accepted")
    run_available(outcomes.where(F.col(key).isNull()), "rejected", f"{root}/rejected")
    return log


def rejected_outcomes(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows that ``log_outcomes`` could not log, each as often as it was delivered."""
    return spark.read.schema(schema).parquet(f"{root}/rejected/out")


def append_to(stream: DataFrame, path: str, progress: str):
    """A running append of a stream to a Parquet table; the caller stops it."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", progress).start()
    )
