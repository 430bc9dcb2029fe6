"""Corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the last return the columns of documents (doc_id, text,
source and n_chars are used by name; others of any name are carried). run() writes each stage's result and then drops what the stage wrote for itself into the shared folder; a stage that is called by
itself leaves that until the Spark application ends, for its result may read it. Nothing is held between calls: runs and sessions do not touch each other's tables, and a result stays readable after
further runs.

Null and empty texts and texts under 20 words go in the first stage, which judges repeated rows and rows without a doc_id each for itself. Of near duplicates and of rows that repeat a doc_id one stays;
ties go to the smaller doc_id, then the smaller text, then the smaller other columns. Very long texts are used whole everywhere. An empty table gives empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrain.llm.common import collecting, dropped, n_words, saved, table
from newsgrain.llm.mixing import mix, placed
from newsgrain.llm.ngram_join import near_duplicates
from newsgrain.llm.packing import pack
from newsgrain.llm.quality_rules import quality_rules
from newsgrain.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules(docs, docs.columns).where("kept").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id; of rows that repeat a doc_id, the one with the smallest text. Rows without a doc_id stay."""
    found = saved(near_duplicates(docs), "found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(gone, "doc_id", "left_anti")
    # a repeated doc_id leaves one row; without repeats the counts say so and nothing is shuffled
    repeated = saved(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left.select("row.*")
    least = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("row.text", "row")).alias("least"))
    return left.join(repeated, "doc_id", "left_anti").select("row.*").unionByName(least.select("least.row.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; untouched where there is none. Documents of which nothing is left go. n_chars follows the text."""
    out = substring_dedup(docs, docs.columns).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(cut, F.length("kept")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, twice where it takes them twice, in the order of their training positions."""
    return placed(docs, mix(docs)).repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which bin each part of each document goes to."""
    return pack(docs, n_words(F.col("text")))


STAGES = [("quality rules", quality), ("near duplicates", one_of_each), ("repeated passages", passages), ("mixing", mixed), ("packing", packed)]

#: The label model of the first stage and the packing are iterations that SQL does not express; a test holds run() against a chain of brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, written. What lies between is dropped as soon as the next stage's result is there."""
    docs, before = table(spark, sf_dir), []
    for name, f in STAGES:
        own: list[DataFrame] = []
        with collecting(own):
            after = f(spark, docs, sf_dir)
        docs = saved(after, name.replace(" ", "-"))
        dropped(*own, *before)
        before = [docs]
    return docs
