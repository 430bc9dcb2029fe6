"""What the corpus operators share: reading tables, cutting lineage in the shared folder, words as columns."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own if all of Spark is this process (tests); a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="newsgrain-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_within: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("collecting", default=())


@contextlib.contextmanager
def collecting(tables: list[DataFrame]) -> Iterator[None]:
    """Tables that saved() makes inside are added to the list, so that their owner can drop them once nothing reads them any more."""
    before = _within.set((*_within.get(), tables))
    try:
        yield
    finally:
        _within.reset(before)


def saved(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there and lost executors cost nothing but their running tasks. The files go when dropped() is
    called, at the latest when the Spark application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    for tables in _within.get():
        tables.append(out)
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by saved() that no later step reads, and let Spark clean the shuffle files of finished steps."""
    for df in frames:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.saved_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    if frames:
        frames[0].sparkSession._jvm.System.gc()
