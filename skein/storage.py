"""Shared folder for intermediate tables.

``spark.checkpoint.dir`` names a folder that the driver and every executor can
reach. Intermediate results are written there as Parquet, which cuts lineage and
survives the loss of executors. Where the setting is absent (tests, one machine)
a temporary folder of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="skein-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


#: Shuffle files of a write are deleted when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator run; ``drop`` deletes those that are no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and read it back."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables, or everything of this run where none is named."""
        jvm = self.spark._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


SMALL_SPLIT = 32 << 20


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A Parquet table. A small one in fewer files than there are cores is dealt to all of them by ``key``.

    Such a file often is one row group, which one task would read and work through alone. Larger tables, and those of
    many files, are read as they lie.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if key is None or size > SMALL_SPLIT * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores, key)


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for each context."""
    import pathlib
    import zipfile

    # Rows here are texts and sets of them: a batch of 10,000 would take tens of MB in each JVM and Python worker at once.
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    sc, here = spark.sparkContext, pathlib.Path(__file__).resolve().parent
    if getattr(sc, "_skein_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="skein-zip-")  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/skein_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(path)
    sc._skein_shipped = True
