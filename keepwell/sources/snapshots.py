"""Dated snapshots of feature groups: versions, commits and clustered files.

A write puts every group into a new folder that no reader looks into. Only when all
groups are there is the version committed: a finished entry file is renamed into
``root/commits/<date>/<version>.json``, which fails if that version exists. Readers go
through the entries alone, so a date is either there as a whole or not at all, an
earlier version stays readable, and of two writers each gets a version of its own.

With ``buckets`` the groups are hash-clustered by the key. Joins of groups with equal
bucket counts then need no shuffle, however many groups there are. The layout is part of
the entry; a reader names the files in its own session catalog by it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from keepwell.functions import values as V

COMMITS = "commits"
_ENTRY = "snapshot_date string, version int, folder string, key string, buckets int, groups map<string,string>"


class SnapshotMissing(FileNotFoundError):
    """No committed version of a date, or none that holds a group."""


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str, snapshot_date: str) -> list[int]:
    """The committed versions of a date, ascending."""
    store, place = _store(spark, f"{root}/{COMMITS}/{snapshot_date}")
    if not store.exists(place):
        return []
    names = [s.getPath().getName() for s in store.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All committed versions of all dates as rows."""
    store, place = _store(spark, f"{root}/{COMMITS}")
    if not store.exists(place):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).json(f"{root}/{COMMITS}/*/[0-9]*.json")


def _entry(spark: SparkSession, root: str, snapshot_date: str, version: int | None) -> dict:
    found = versions(spark, root, snapshot_date)
    if not found or version is not None and version not in found:
        raise SnapshotMissing(f"no committed snapshot {snapshot_date}" + (f" version {version}" if version else "") + f" in {root}")
    path = f"{root}/{COMMITS}/{snapshot_date}/{version or found[-1]:06d}.json"
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def write_files(snapshot: DataFrame, root: str, snapshot_date: str, groups: dict[str, list[str]] = V.GROUP_COLUMNS,
                key: str = "customerID", buckets: int | None = None) -> dict:
    """Writes the groups into a new folder and returns the entry that would commit them."""
    folder = f"run-{uuid.uuid4().hex}"
    layout = {}
    for name, columns in groups.items():
        rows, path = snapshot.select(*columns), _path(root, name, snapshot_date, folder)
        if buckets is None:
            rows.write.parquet(path)
        else:
            rows = rows.repartition(buckets, key)  # one file per bucket
            rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(_table(path))
        layout[name] = rows.schema.json()
    return {"snapshot_date": snapshot_date, "folder": folder, "key": key, "buckets": buckets, "groups": layout}


def commit(spark: SparkSession, root: str, entry: dict) -> int:
    """Makes written files the next version of their date; returns its number."""
    day = f"{root}/{COMMITS}/{entry['snapshot_date']}"
    while True:
        version = (versions(spark, root, entry["snapshot_date"]) or [0])[-1] + 1
        if _put_once(spark, day, f"{version:06d}.json", json.dumps(entry | {"version": version})):
            return version


def _put_once(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """A file that appears with all its content or not at all; False if the name is taken."""
    store, aside = _store(spark, f"{folder}/.writing-{uuid.uuid4().hex}")
    out = store.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    no_overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    place = store.makeQualified(aside)
    files = fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(place, store.makeQualified(fs.Path(f"{folder}/{name}")), no_overwrite)
    except Exception as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        store.delete(aside, False)
        return False
    return True


def write_groups(snapshot: DataFrame, root: str, snapshot_date: str, groups: dict[str, list[str]] = V.GROUP_COLUMNS,
                 key: str = "customerID", buckets: int | None = None) -> int:
    """One table per feature group, committed together as the date's next version, whose number is returned."""
    return commit(snapshot.sparkSession, root, write_files(snapshot, root, snapshot_date, groups, key, buckets))


def read_group(spark: SparkSession, root: str, name: str, snapshot_date: str, version: int | None = None) -> DataFrame:
    """One group of one date, the latest version unless one is named; raises when it was never committed."""
    return _read(spark, root, name, _entry(spark, root, snapshot_date, version))


def _read(spark: SparkSession, root: str, name: str, entry: dict) -> DataFrame:
    if name not in entry["groups"]:
        raise SnapshotMissing(f"no snapshot {entry['snapshot_date']} of {name} in {root}")
    path = _path(root, name, entry["snapshot_date"], entry["folder"])
    schema = StructType.fromJson(json.loads(entry["groups"][name]))
    if entry["buckets"] is None:
        return spark.read.schema(schema).parquet(path)
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    key, place = _quoted(entry["key"]), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(path)} ({columns}) USING parquet "
              f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(entry['buckets'])} BUCKETS LOCATION '{place}'")
    return spark.table(_table(path))


def join_groups(groups: list[DataFrame], key: str = "customerID") -> DataFrame:
    """Inner joins on the key; a column already present is not taken again."""
    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        new = [c for c in right.columns if c == key or c not in left.columns]
        return left.join(right.select(*new), key, "inner")

    return reduce(add, groups)


def read_snapshot(spark: SparkSession, root: str, snapshot_date: str, groups: list[str] | None = None,
                  version: int | None = None) -> DataFrame:
    """Groups of one version joined on the key they were written by: all from the same commit."""
    entry = _entry(spark, root, snapshot_date, version)
    return join_groups([_read(spark, root, g, entry) for g in groups or list(V.GROUP_COLUMNS)], entry["key"])


def _path(root: str, name: str, snapshot_date: str, folder: str) -> str:
    return f"{root}/{name}/snapshot_date={snapshot_date}/{folder}"


def _table(path: str) -> str:
    return f"keepwell_group_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
