"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a local master gets a folder of its own; a cluster is refused,
    since its machines don't see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="opinara-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(remove, spark, root)
    return root


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        system, where = file_system(spark, path)
        system.delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: later steps don't repeat its lineage, and a lost executor
    takes none of it along."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes durable tables that nothing reads any more, before the driver's end."""
    for table in tables:
        for path in table.inputFiles()[:1]:
            remove(table.sparkSession, path.rsplit("/", 1)[0])


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver's JVM finds them unreachable, which
    on a large heap can take until disks are full. Plans that Python still refers to by cycles go first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
