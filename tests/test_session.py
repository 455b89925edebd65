"""What writing a table of the shared folder leaves behind."""

import time

from pyspark.sql import functions as F

from keepwell.session import CLEANUP, scratch, settle


def test_written_tables_leave_no_shuffle_files_and_the_setting_as_it_was(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().size()
    counted = lambda: spark.range(10_000).groupBy((F.col("id") % 50).alias("k")).count()
    before, setting = files(), spark.conf.get(CLEANUP, None)
    with scratch(spark, "session") as here:
        tables = [settle(counted(), f"counted-{i}") for i in range(5)] + [here(counted(), f"counted-{i}") for i in range(5)]
        for _ in range(50):  # files go behind the job's back
            if files() <= before:
                break
            time.sleep(0.1)
        assert files() <= before
        assert spark.conf.get(CLEANUP, None) == setting
        assert [t.count() for t in tables] == [50] * 10
