"""Session options and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime options every job relies on; none of them depends on the cluster's size.
SQL_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Kept feature tables are read many times: let them, too, shrink to partitions of a useful size.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot member may sit in front of an aggregate: split it even if that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Work tables and loads are read less often than they would fill disks.
    "spark.sql.parquet.compression.codec": "zstd",
    # Keyed state of streams lies on disk, not in the executors' heap, and may have timers.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SQL_OPTIONS.items():
        spark.conf.set(name, value)
    return spark


def own_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the caller's runtime options and, on top, the jobs' own.

    The caller's session keeps its options; data caches and executors are shared.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return tune(own)


def ship(spark: SparkSession, archive: str) -> None:
    """Send the package to the executors, as a zip file at ``archive``, where it is not installed there.

    Functions that run in Python workers are found by import; without this, or a wheel on every executor, they are not.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(archive, "w") as file:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    file.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)


def local_session(cores: str = "8", name: str = "tellerlake") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tellerlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, never reused between calls."""
    return os.path.join(shared_dir(spark), "tellerlake", f"{label}-{uuid.uuid4().hex}")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the work folder and read back: nothing stays in executor memory, and lost executors cost nothing."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
