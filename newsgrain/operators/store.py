"""Writing rounds of an iteration, and what streams give, into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own if all of Spark is this process (tests); a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="newsgrain-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_dir(spark: SparkSession, label: str) -> str:
    """A path that nothing uses yet; its files go when the Spark application ends."""
    where = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    return where


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where: lineage ends there, and lost executors cost only their running tasks."""
    where = new_dir(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


def forget(spark: SparkSession, *places: str) -> None:
    for where in places:
        path, fs = _path(spark, where)
        fs.delete(path, True)


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = _path(spark, where)
    return fs.exists(path)


def children(spark: SparkSession, where: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    path, fs = _path(spark, where)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
