"""Rows that are written once: what was shuffled for them does not stay on disk."""

import time

from pyspark.sql import functions as F

from answergauge.operators.layout import _CLEANUP, materialised


def shuffled_bytes(spark):
    """Bytes of the shuffle files that the session's own process holds."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_shuffle_files_go_with_the_write(spark):
    before = shuffled_bytes(spark)
    rows = spark.range(200000).repartition(4, "id")
    got = materialised(rows.withColumn("digest", F.sha2(F.col("id").cast("string"), 256)))
    for _ in range(100):  # files are deleted in the background
        if shuffled_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled_bytes(spark) <= before
    assert got.count() == 200000


def test_the_setting_is_as_before(spark):
    for value in (None, "false", "true"):
        if value is not None:
            spark.conf.set(_CLEANUP, value)
        try:
            assert materialised(spark.range(3)).count() == 3
            assert spark.conf.get(_CLEANUP, None) == value
        finally:
            spark.conf.unset(_CLEANUP)
