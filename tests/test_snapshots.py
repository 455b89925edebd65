"""Snapshots are there as a whole or not at all, and clustered groups join where they lie."""

import re

import pytest
from pyspark.sql import functions as F

from keepwell.sources import snapshots as S

GROUPS = {"one": ["k", "a"], "two": ["k", "a", "b c"], "three": ["k", "d"]}


def rows(spark, more=0, n=40):
    return spark.range(n).select(F.concat(F.lit("c"), "id").alias("k"), (F.col("id") + more).cast("int").alias("a"),
                                 (F.col("id") / 4).alias("b c"), F.array(F.col("id")).alias("d"))


@pytest.mark.parametrize("buckets", [None, 3])
def test_versions_and_half_written_dates(spark, tmp_path, buckets):
    root = str(tmp_path / "it's a store")
    assert S.versions(spark, root, "2024-03-01") == [] and S.commits(spark, root).count() == 0
    assert S.write_groups(rows(spark), root, "2024-03-01", GROUPS, "k", buckets) == 1
    assert S.write_groups(rows(spark, 7, 50), root, "2024-03-01", GROUPS, "k", buckets) == 2
    entry = S.write_files(rows(spark, 9), root, "2024-04-01", GROUPS, "k", buckets)  # the writer stops here
    S.write_files(rows(spark, 9), root, "2024-03-01", GROUPS, "k", buckets)
    read = lambda *a, **b: S.read_snapshot(spark, root, *a, list(GROUPS), **b)
    with pytest.raises(S.SnapshotMissing):
        read("2024-04-01")
    latest, first = read("2024-03-01"), read("2024-03-01", version=1)
    assert latest.columns == ["k", "a", "b c", "d"] and latest.count() == 50 and latest.agg(F.min("a")).first()[0] == 7
    assert first.exceptAll(rows(spark)).count() == 0 and first.count() == 40
    with pytest.raises(S.SnapshotMissing, match="version 5"):
        read("2024-03-01", version=5)
    with pytest.raises(S.SnapshotMissing, match="of four"):
        S.read_group(spark, root, "four", "2024-03-01")
    assert S.commit(spark, root, entry) == 1 and read("2024-04-01").count() == 40
    assert [(r.snapshot_date, r.version) for r in S.commits(spark, root).orderBy("snapshot_date", "version").collect()] == [
        ("2024-03-01", 1), ("2024-03-01", 2), ("2024-04-01", 1)]


def test_two_writers_get_two_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    one, two = (S.write_files(rows(spark, m), root, "2024-03-01", GROUPS, "k") for m in (0, 5))
    real, seen = S.versions, []

    def late(*args):
        found = real(*args)
        if not seen:  # the other writer commits between the look and the rename
            seen.append(1)
            S.commit(spark, root, two)
        return found

    monkeypatch.setattr(S, "versions", late)
    assert S.commit(spark, root, one) == 2
    monkeypatch.undo()
    assert S.read_group(spark, root, "one", "2024-03-01", 1).agg(F.min("a")).first()[0] == 5
    assert S.read_group(spark, root, "one", "2024-03-01").agg(F.min("a")).first()[0] == 0
    assert not [p for p in (tmp_path / "store" / "commits" / "2024-03-01").iterdir() if p.name.startswith(".writing")]


def test_clustered_groups_join_without_a_shuffle(spark, tmp_path):
    root = str(tmp_path / "store")
    S.write_groups(rows(spark, n=500), root, "2024-03-01", GROUPS, "k", 6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for session in (spark, spark.newSession()):  # the second one has only the files and the entry to go by
            joined = S.read_snapshot(session, root, "2024-03-01", list(GROUPS))
            session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
            assert joined.count() == 500
            assert len(re.findall(r"Bucketed: true", plan)) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
