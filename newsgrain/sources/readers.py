"""Readers of article exports, finance tables and embedding dumps. Those of label records are in label_records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def normalized_headers(df: DataFrame) -> DataFrame:
    """Header names trimmed, without byte-order mark, in lower case."""
    return df.toDF(*[c.lstrip("﻿").strip().strip('"').lower() for c in df.columns])


def read_articles_csv(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Article exports: id, title, body, source_name, date, collection. The collection filter comes before the removal of repeats by title, then by id; the first in file order stays."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path)
    df = normalized_headers(raw)
    pick = lambda *names: F.coalesce(*[F.col(f"`{n}`") for n in names if n in df.columns], F.lit(None).cast("string"))
    d = df.select(pick("atom id", "id").alias("doc_id"), pick("title").alias("title"), F.trim(F.regexp_replace(pick("body", "text"), r"[\r\n]+", " ")).alias("body"), pick("source name").alias("source_name"), C.parse_flexible_date(pick("source date, start", "date")).alias("date"), pick("collection name").alias("collection"), F.monotonically_increasing_id().alias("at"))
    d = d.where("doc_id IS NOT NULL AND body IS NOT NULL AND body <> ''")
    d = d.where(F.col("collection") == collection) if collection else d
    for key in ("title", "doc_id"):
        first = F.row_number().over(W.partitionBy(F.coalesce(key, F.concat(F.lit("#"), F.col("at").cast("string")))).orderBy("at"))
        d = d.withColumn("_r", first).where("_r = 1").drop("_r")
    return d.drop("at")


def yes_no(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin("yes", "y", "true", "1"), True).when(F.lower(F.trim(c)).isin("no", "n", "false", "0"), False)


def whole(c: Column) -> Column:
    return F.expr("NULL").cast("int") if c is None else c.try_cast("double").cast("int")


def read_finance_projects(spark: SparkSession, path: str) -> DataFrame:
    d = normalized_headers(spark.read.option("header", True).csv(path))
    return d.select(F.trim("project id").alias("project_id"), C.normalize_na(F.col("title")).alias("title"), whole(F.col("commitment year")).alias("commitment_year"), F.col("amount").try_cast("double").alias("amount"), yes_no(F.col("recommended for aggregates")).alias("recommended"), C.parse_flexible_date(F.col("start date")).alias("start_date"))


def read_finance_locations(spark: SparkSession, path: str, projects: DataFrame) -> DataFrame:
    d = normalized_headers(spark.read.option("header", True).csv(path))
    return d.select(F.trim("project id").alias("project_id"), "adm1", "adm2").join(projects.select("project_id"), "project_id", "left_semi")


def read_embeddings_parquet(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """doc_id and embedding from dumps whose vectors are arrays or text and whose ids may stand in JSON metadata; ids already loaded are left out."""
    d = spark.read.option("mergeSchema", True).parquet(path)
    kind = dict(d.dtypes)["embedding"]
    vector = F.from_json("embedding", "array<float>") if kind == "string" else F.col("embedding").cast("array<float>")
    id_ = F.coalesce(*[F.col(c).cast("string") for c in ("doc_id", "id") if c in d.columns], *([F.get_json_object("metadata", "$.doc_id")] if "metadata" in d.columns else []))
    out = d.select(id_.alias("doc_id"), vector.alias("embedding")).where("doc_id IS NOT NULL")
    return out if existing is None else out.join(existing.select("doc_id"), "doc_id", "left_anti")
