"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "keepwell", **conf: str) -> SparkSession:
    """A session with the settings the operators were planned for.

    AQE coalesces shuffle partitions from measured sizes, so the width may be set
    high, and splits skewed join partitions. Generated methods too long for the JIT
    are not fused. ``conf`` wins over the defaults.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall
    back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="keepwell-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` to a new path and gives the table there.

    Its shuffle files go as soon as it is written, by Spark's own setting: else they stay
    until the driver happens to collect its garbage, and a job of many steps keeps them all.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from that table.

    Used where a reduced table is read several times: the big scan behind it runs
    once, later reads prune columns and know the size, and a lost executor costs a
    re-read instead of a re-computation.
    """
    return write_table(df, scratch_path(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the store that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``settle`` for tables that are needed within a block only; they are deleted at its end.

    What leaves the block must have been settled elsewhere.
    """
    root = scratch_path(spark, name)

    def here(df: DataFrame, label: str) -> DataFrame:
        return write_table(df, f"{root}/{label}-{uuid.uuid4().hex[:8]}")

    try:
        yield here
    finally:
        delete(spark, root)


@contextmanager
def scratch_clustered(df: DataFrame, name: str, key: str) -> Iterator[DataFrame]:
    """``df`` as a table for a block, clustered by a column: what meets it by that column is shuffled to where it lies."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    # with fewer buckets than a shuffle has partitions, Spark would shuffle the table nevertheless
    buckets = max(int(spark.conf.get(c, None) or 1) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    try:
        df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, path)
