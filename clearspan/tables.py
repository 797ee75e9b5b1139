"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("clearspan.scratch.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("clearspan.scratch.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes a table that stored() made, as soon as nothing still to be computed reads it. Others stay until the driver ends."""
    jvm = table.sparkSession._jvm
    for file in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
