"""Session helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "fraudspark") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FRAUDSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC everywhere; window bounds and hour-of-day depend on it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a scratch folder of its own; on a cluster that is an error, since
    executors do not see each other's disks.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder which the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fraudspark-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the rows survive the loss of executors."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """As ``cut_lineage``, as a table: compressed columns, in place of rows as they are in memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name for intermediate tables and stream progress, below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of what nothing refers to any more; else they stay until the driver's heap fills up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship_package() -> None:
    """Functions and classes of this package travel to the Python workers with the task, not by name.

    The package is then needed on the driver only.
    """
    import fraudspark

    register_pickle_by_value(fraudspark)
