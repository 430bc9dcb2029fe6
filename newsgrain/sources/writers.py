"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned_export(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """zstd Parquet by partition, and a manifest of row counts beside it."""
    df.write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(f"{path}/data")
    df.sparkSession.read.parquet(f"{path}/data").groupBy(*partition_by).agg(F.count("*").alias("rows")).write.mode("overwrite").json(f"{path}/manifest")


def write_chart_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One ordered CSV beside a figure (a few rows)."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
