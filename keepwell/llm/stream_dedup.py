"""Exact dedup as a stream: disk-backed keyed state without expiry.

Arriving rows are reduced to a digest of their normalised text, their stable
identifier and the locator of their content (a hash of file and row number), and
logged. A streaming aggregation over that log keeps, per digest and for good, the
smallest identifier seen, the locator of that row and the number of rows: state in
RocksDB on the executors' disks, with its own log in the shared folder. Partial
aggregates go ahead of the shuffle, so a text that makes up a third of all rows
reaches its state as one row per task. A restarted stream goes on from its folder; a
batch that is repeated replaces what it wrote before.

A digest only finds hits. The contents of all rows that share one are fetched by
their locators and compared byte by byte, as the smallest and the largest content per
digest, which again merges within tasks; rows that differ although their digests
agree form groups of their own. A bit table of bounded size keeps all other texts
out of the shuffle.

Defined cases: null counts as the empty text; rows that repeat an identifier and text
share one verdict; null identifiers rank last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keepwell.llm.base import maybe_member, membership
from keepwell.session import scratch_path, settle

_LAST = (1 << 63) - 1
_CHANGE = "digest string, rank long, locator long, n long"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def locator() -> Column:
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def exact_name(path: str) -> str:
    """A pattern that only ``path`` matches: a stream takes a file or a folder by it alike."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


MAX_AGE = "36500d"


def _stream(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    # without a long age, a run taken up again passes over new files that are dated a week before the newest one seen
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", MAX_AGE).parquet(path)


def ingest(spark: SparkSession, path: str, key: str, text: str, digest, folder: str, files_per_batch: int) -> DataFrame:
    """First stream: every new row of the files as (id, digest, rank, locator), appended to the log of arrivals."""
    rows = _stream(spark, exact_name(path), spark.read.parquet(path).schema, files_per_batch)
    arrived = rows.select(F.col(key).alias("id"), digest(normalised(F.col(text))).alias("digest"),
                          F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("rank"), locator().alias("locator"))
    (arrived.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/arrivals")
     .option("checkpointLocation", f"{folder}/arrivals-progress").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(arrived.schema).parquet(f"{folder}/arrivals")


def keep_state(spark: SparkSession, arrived: DataFrame, folder: str, files_per_batch: int) -> DataFrame:
    """Second stream: the state per digest, brought up to date with the log of arrivals.

    Returns digest, rank (the smallest), locator (of that row), n.
    """
    state = (_stream(spark, f"{folder}/arrivals", arrived.schema, files_per_batch).groupBy("digest")
             .agg(F.min("rank").alias("rank"), F.min_by("locator", "rank").alias("locator"), F.count(F.lit(1)).alias("n")))
    spark.createDataFrame([], _CHANGE).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")  # the folder exists

    def record(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        (state.writeStream.outputMode("update").foreachBatch(record).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(_CHANGE).parquet(f"{folder}/changes").groupBy("digest").agg(
        F.min("rank").alias("rank"), F.min_by("locator", "rank").alias("locator"), F.max("n").alias("n"))


def contents(spark: SparkSession, path: str, text: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (locator, ...) with ``content``, the normalised text; only texts that may be wanted are shuffled."""
    rows = spark.read.parquet(path).select(locator().alias("locator"), F.col(text).alias("content"))
    found = maybe_member(rows, "locator", membership(wanted, "locator")).join(wanted, "locator")
    return found.withColumn("content", normalised(F.col("content")))


def dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest=sha256_of,
          folder: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """One row per row of the files: id, keep_id, group_size, kept, digest.

    ``folder`` holds both logs, progress and state; name it to go on with a growing
    set of files, else a new one in the shared folder is taken.
    """
    folder = folder or scratch_path(spark, "stream-dedup")
    arrived = ingest(spark, path, key, text, digest, folder, files_per_batch)
    keepers = settle(keep_state(spark, arrived, folder, files_per_batch), "keepers")
    found = arrived.join(keepers.select("digest", F.col("rank").alias("keep"), F.col("locator").alias("kept_at"), "n"), "digest")

    # every hit against the others of its digest, byte by byte: equal if the smallest and the largest content are
    hits = found.where("n > 1").select("locator", "digest")
    bytes_of = contents(spark, path, text, hits).groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    clashes = settle(bytes_of.where("low != high").select("digest"), "clashes")
    if not clashes.isEmpty():  # a digest shared by different texts: these are grouped by the text itself
        parted = settle(contents(spark, path, text, found.join(clashes, "digest", "left_semi").select("locator", "digest", "rank")), "parted")
        own = parted.groupBy("digest", "content").agg(F.min("rank").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
        named = parted.join(own, ["digest", "content"]).select("locator", "own_keep", "own_n")
        found = found.join(named, "locator", "left").withColumns(
            {"keep": F.coalesce("own_keep", "keep"), "n": F.coalesce("own_n", "n")})
    return found.select("id", F.when(F.col("keep") != _LAST, F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("rank") == F.col("keep")).alias("kept"), "digest")
