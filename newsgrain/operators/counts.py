"""Scopes and distinct-document counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..scope import Scope


def scope_pairs(d: DataFrame, ic: DataFrame, rc: DataFrame, scope: Scope, end: bool = True) -> DataFrame:
    """Documents with each in-scope (initiator, recipient) pair, initiator <> recipient, since the start (and before the end)."""
    when = (F.col("date") >= F.lit(scope.start).cast("date")) & ((F.col("date") < F.lit(scope.end).cast("date")) if end else F.lit(True))
    i = ic.where(F.col("initiating_country").isin(*scope.influencers))
    r = rc.where(F.col("recipient_country").isin(*scope.recipients))
    return d.where(when).join(i, "doc_id").join(r, "doc_id").where("initiating_country <> recipient_country")


def scope_docs(d: DataFrame, ic: DataFrame, rc: DataFrame, scope: Scope) -> DataFrame:
    return scope_pairs(d.select("doc_id", "date"), ic, rc, scope, end=False).select("doc_id").distinct()


def apply_filters(df: DataFrame, *, countries: Sequence[str] = (), recipients: Sequence[str] = (), start: str | None = None, end: str | None = None, scope: Scope) -> DataFrame:
    """Optional list and date filters on a frame of scope_pairs; a missing start is the scope's."""
    df = df.where(F.col("date") >= F.lit(start or scope.start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if countries:
        df = df.where(F.col("initiating_country").isin(*countries))
    if recipients:
        df = df.where(F.col("recipient_country").isin(*recipients))
    return df


def doc_scope(d: DataFrame, ic: DataFrame, rc: DataFrame, cat: DataFrame, sub: DataFrame, *, influencer: str | None = None, recipients: Sequence[str] = (), category: str | None = None, subcategory: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Documents by semi joins only, so that nothing fans out; closed date range."""
    if start:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        d = d.where(F.col("date") <= F.lit(end).cast("date"))
    for bridge, column, values in ((ic, "initiating_country", [influencer] if influencer else []), (rc, "recipient_country", list(recipients)), (cat, "category", [category] if category else []), (sub, "subcategory", [subcategory] if subcategory else [])):
        if values:
            d = d.join(bridge.where(F.col(column).isin(*values)).select("doc_id"), "doc_id", "left_semi")
    return d


def count_docs(df: DataFrame, dims: Sequence[str | Column], distinct: bool = True, k: int | None = None, unknown: str | None = None, approx: bool = False) -> DataFrame:
    """Documents by any dimensions, top k by count with the dimensions as tiebreak. unknown: the name for null labels."""
    cols = [F.col(c) if isinstance(c, str) else c for c in dims]
    if unknown:
        cols = [F.coalesce(c, F.lit(unknown)).alias(n) if isinstance(n, str) else c for c, n in zip(cols, dims, strict=True)]
    n = F.approx_count_distinct("doc_id") if approx else F.count_distinct("doc_id") if distinct else F.count("*")
    out = df.groupBy(*cols).agg(n.alias("n_docs"))
    names = [c for c in out.columns if c != "n_docs"]
    return out if k is None else out.orderBy(F.desc("n_docs"), *[F.col(c).asc_nulls_last() for c in names]).limit(k)


def docs_per_period(df: DataFrame, unit: str, dims: Sequence[str] = (), last: int | None = None) -> DataFrame:
    """Distinct documents by week (from Monday), month or day and further dimensions; last: only the newest periods, in order."""
    out = count_docs(df.withColumn(unit, F.col("date") if unit == "day" else F.trunc("date", unit)), [unit, *dims])
    return out if last is None else out.orderBy(F.desc(unit)).limit(last).orderBy(unit)


def cube_by_week(df: DataFrame) -> DataFrame:
    """Per week, a map of `recipient|initiator` to documents."""
    g = docs_per_period(df, "week", ["recipient_country", "initiating_country"])
    pair = F.concat("recipient_country", F.lit("|"), "initiating_country")
    return g.groupBy("week").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(pair, "n_docs")))).alias("counts"))


def self_flags(df: DataFrame) -> DataFrame:
    """self_reported, null for a null geofocus."""
    return df.withColumn("self_reported", C.self_reported(F.col("source_geofocus"), F.col("initiating_country")))


def overview_metrics(pairs: DataFrame) -> DataFrame:
    """One row: documents, corroborated documents, self share, active pairs and recipients, in one pass over (document, pair)."""
    by_doc = self_flags(pairs)
    other = F.when(~F.coalesce(F.col("self_reported"), F.lit(False)), F.col("doc_id"))
    return by_doc.agg(
        F.count_distinct("doc_id").alias("total_docs"),
        F.count_distinct(other).alias("corroborated_docs"),
        F.count_distinct("initiating_country", "recipient_country").alias("active_pairs"),
        F.count_distinct("recipient_country").alias("active_recipients"),
    ).select("*", F.round(1 - F.col("corroborated_docs") / F.nullif("total_docs", F.lit(0)), 3).alias("self_share"))


def rollup_cube(base: DataFrame) -> DataFrame:
    """CUBE over initiator, recipient and category of distinct documents."""
    return base.cube("initiating_country", "recipient_country", "category").agg(F.count_distinct("doc_id").alias("n_docs"), F.grouping_id().cast("long").alias("level"))


def shared_recipients(pairs: DataFrame, least: int = 2) -> DataFrame:
    g = pairs.groupBy("recipient_country").agg(F.count_distinct("initiating_country").alias("n_actors"), F.count_distinct("doc_id").alias("n_docs"))
    return g.where(F.col("n_actors") >= least)


def source_diversity(df: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(F.trunc("date", "month").alias("month")).agg(count("source_name").alias("distinct_sources"), count("doc_id").alias("n_docs"))


def search_documents(d: DataFrame, cat: DataFrame, ic: DataFrame, *, term: str, country: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """Documents whose title or text holds the term, newest first, with their labels joined."""
    hit = d.where(F.col("title").ilike(f"%{term}%") | F.col("distilled_text").ilike(f"%{term}%"))
    if country:
        hit = hit.join(ic.where(F.col("initiating_country") == country).select("doc_id"), "doc_id", "left_semi")
    shown = hit.orderBy(F.desc("date"), "doc_id").offset((page - 1) * size).limit(size)
    labels = cat.join(F.broadcast(shown.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("category")), "; ").alias("categories"))  # one page of ids
    return shown.select("doc_id", "date", "title").join(labels, "doc_id", "left")


def document_details(docs: DataFrame, cat: DataFrame, rc: DataFrame) -> DataFrame:
    g = lambda b, c, n: b.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(n))
    return docs.select("doc_id", "date", "title").join(g(cat, "category", "categories"), "doc_id", "left").join(g(rc, "recipient_country", "recipients"), "doc_id", "left")


def share_of_total(df: DataFrame, x: str, digits: int = 2, within: Sequence[str] = ()) -> DataFrame:
    """100 * x over its sum, in all or within groups."""
    return df.withColumn("share", F.round(100.0 * F.col(x) / F.sum(x).over(W.partitionBy(*within)), digits))


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def leader_per_group(df: DataFrame, keys: Sequence[str], name: str, x: str) -> DataFrame:
    """Name with the largest x, the smaller name on ties."""
    g = df.groupBy(*keys).agg(F.min(F.struct((-F.col(x)).alias("v"), F.col(name).alias("name"))).alias("best"))
    return g.select(*keys, F.col("best.name").alias("leader"), (-F.col("best.v")).alias("leader_docs"))
