"""Copies against plain grouping; weak digests, later files, restarts and odd rows."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from keepwell.llm.stream_dedup import dedup, exact_name

NORM = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[NORM(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[NORM(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(map(str, out))


def found(df):
    return sorted(str((r.id, r.keep_id, r.group_size, r.kept)) for r in df.collect())


ROWS = [(5, "a  b\tc"), (3, "a b c"), (9, "a b\nc"), (1, "A b c"), (2, None), (4, ""), (6, "a b c"), (7, "x " * 100_000),
        (8, "x  " * 100_000), (None, "lone"), (3, "a b c"), (10, " a b c")]


def write(spark, rows, path, mode="overwrite", parts=3):
    spark.createDataFrame([(i, t, "d", 1) for i, t in rows], "doc_id long, text string, digest string, n int").repartition(parts).write.mode(mode).parquet(path)


def test_groups_and_full_bytes(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    write(spark, ROWS, path)
    assert found(dedup(spark, path)) == expected(ROWS)
    weak = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(2)).cast("string")
    assert found(dedup(spark, path, digest=weak, files_per_batch=1)) == expected(ROWS)
    write(spark, [], path)
    assert dedup(spark, path).collect() == []


def test_state_lasts_over_restarts(spark, tmp_path):
    path, folder = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    write(spark, ROWS, path)
    write(spark, [(99, "a b c")], str(tmp_path / "docs.parquet_old"))
    assert found(dedup(spark, path, folder=folder, files_per_batch=1)) == expected(ROWS)
    more = [(0, "a b c"), (50, "new"), (51, "lone")]
    write(spark, more, path, mode="append")
    assert found(dedup(spark, path, folder=folder)) == expected(ROWS + more)
    assert found(dedup(spark, path, folder=folder)) == expected(ROWS + more)


def test_exact_name():
    assert exact_name("/a/b.parquet/") == "/a/b.parque[t]"


def test_old_dated_files_of_a_later_run_are_read(spark, tmp_path):
    import os
    import time

    from keepwell.llm.stream_dedup import dedup
    from keepwell.streaming.jobs import read_files

    path, folder = str(tmp_path / "docs"), str(tmp_path / "progress")

    def streamed():
        rows = read_files(spark, path, spark.read.parquet(path).schema)
        (rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/rows-progress")
         .trigger(availableNow=True).start().awaitTermination())
        return spark.read.parquet(f"{folder}/rows").count()

    def add(rows, days):
        before = set(tmp_path.glob("docs/part-*"))
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        for file in set(tmp_path.glob("docs/part-*")) - before:
            os.utime(file, (time.time() - days * 86400,) * 2)

    add([(2, "a"), (3, "b")], 0)
    assert dedup(spark, path, folder=f"{folder}/dedup").count() == 2 and streamed() == 2
    add([(1, "a"), (4, "c")], 30)
    rows = {r.id: (r.keep_id, r.group_size, r.kept) for r in dedup(spark, path, folder=f"{folder}/dedup").collect()}
    assert rows == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True), 4: (4, 1, True)}
    assert streamed() == 4
