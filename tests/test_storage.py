"""Intermediate tables."""

import time

from pyspark.sql import functions as F

from skein import storage


def test_shuffle_files_of_a_written_table_go(spark):
    """Else they stay until the driver's garbage is collected."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().endswith(".data")}

    before, setting = files(), spark.conf.get(storage.CLEANUP, None)
    saved = storage.Scratch(spark).save(spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).agg(F.count("*").alias("n")), "t")
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and saved.count() == 999 and spark.conf.get(storage.CLEANUP, None) == setting
