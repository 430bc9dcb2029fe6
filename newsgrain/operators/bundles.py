"""Page-sized bundles of figures in long form: one frame for each, of (section, key, ...) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .counts import self_flags
from .store import written


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def third_party(df: DataFrame) -> DataFrame:
    """Column third: the document is not by the initiator's own media (a null geofocus counts as third-party)."""
    return self_flags(df).withColumn("third", ~F.coalesce("self_reported", F.lit(False)))


def section(df: DataFrame, name: str, key: Column, k: int | None = None, newest: int | None = None) -> DataFrame:
    """section, key, n_docs, corroborated of df (doc_id, third): distinct documents by key; the k largest, or the newest keys."""
    one = df.groupBy(key.cast("string").alias("key"), "doc_id").agg(F.max("third").alias("third"))
    g = one.groupBy("key").agg(F.count("*").alias("n_docs"), F.count_if("third").alias("corroborated"))
    if k:
        g = g.orderBy(F.desc("n_docs"), "key").limit(k)
    if newest:
        g = g.orderBy(F.desc("key")).limit(newest)
    return g.select(F.lit(name).alias("section"), "key", "n_docs", "corroborated")


def document_metrics(pairs: DataFrame, cat: DataFrame, sub: DataFrame) -> DataFrame:
    """Everything about a set of document pairs: total, categories, subcategories, initiators, recipients, the newest twelve months and the twenty largest sources."""
    p = third_party(pairs.select("doc_id", "date", "source_name", "source_geofocus", "initiating_country", "recipient_country"))
    docs = p.groupBy("doc_id").agg(F.max("third").alias("third"))
    month = F.date_format("date", "yyyy-MM")
    return stacked([
        section(docs, "total", F.lit("documents")),
        section(docs.join(cat, "doc_id"), "category", F.col("category")),
        section(docs.join(sub, "doc_id"), "subcategory", C.clean_subcategory(F.col("subcategory"))),
        section(p, "initiator", F.col("initiating_country")),
        section(p, "recipient", F.col("recipient_country")),
        section(p.where("date IS NOT NULL"), "month", month, newest=12),
        section(p.where("source_name IS NOT NULL"), "source", F.col("source_name"), k=20),
    ])


def drilldown(pairs: DataFrame, cat: DataFrame, sub: DataFrame, newest: int = 20, sources: int = 15) -> DataFrame:
    """section, key, n_docs, day of the documents behind a clicked chart: total, date range, five distributions, monthly trend, sources and the newest documents."""
    # nine sections ask for the clicked pairs
    pairs, _ = written(pairs.select("doc_id", "date", "source_name", "initiating_country", "recipient_country"), "clicked")
    ids = pairs.select("doc_id").distinct()
    dim = lambda df, name, c, k=None: section(df.withColumn("third", F.lit(True)), name, c, k).drop("corroborated")
    span = pairs.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    ranges = [span.select(F.lit("range").alias("section"), F.lit(c).alias("key"), F.col(c).alias("day")) for c in ("first", "last")]
    docs = pairs.where("date IS NOT NULL").select("doc_id", "date").distinct().orderBy(F.desc("date"), "doc_id").limit(newest)
    # twenty rows are ranked
    shown = docs.select(F.lit("document").alias("section"), F.col("doc_id").cast("string").alias("key"), F.row_number().over(W.orderBy(F.desc("date"), "doc_id")).cast("long").alias("n_docs"), F.col("date").alias("day"))
    return stacked([
        dim(ids, "total", F.lit("documents")).withColumn("day", F.lit(None).cast("date")),
        *ranges,
        dim(ids.join(cat, "doc_id"), "category", F.col("category")),
        dim(ids.join(sub, "doc_id"), "subcategory", F.col("subcategory")),
        dim(pairs, "recipient", F.col("recipient_country")),
        dim(pairs, "initiator", F.col("initiating_country")),
        dim(pairs.where("date IS NOT NULL"), "month", F.date_format("date", "yyyy-MM")),
        dim(pairs.where("source_name IS NOT NULL"), "source", F.col("source_name"), sources),
        shown,
    ])


def competing_influence(pairs: DataFrame, cat: DataFrame, ce: DataFrame, recipient_counts: DataFrame, recipient: str, newest: int = 3) -> DataFrame:
    """For one recipient, by initiator: documents, corroborated and self share, events and their mean score, leading category; months; categories raw and corroborated; the newest events."""
    p = third_party(pairs.where(F.col("recipient_country") == recipient)).select("doc_id", "date", "initiating_country", "third").distinct()
    who = "initiating_country"
    by = p.groupBy(who).agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(F.when(F.col("third"), F.col("doc_id"))).alias("corroborated"))
    about = ce.where("master_event_id IS NULL").join(recipient_counts.where(F.col("key") == recipient).select("id"), "id", "left_semi")
    events = about.groupBy(who).agg(F.count("*").alias("n_events"), F.round(F.avg(F.col("material_score").cast("double")), 2).alias("mean_score"))
    cats = p.join(cat, "doc_id").groupBy(who, F.col("category").alias("key")).agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(F.when(F.col("third"), F.col("doc_id"))).alias("corroborated"))
    lead = cats.groupBy(who).agg(F.min(F.struct((-F.col("n_docs")).alias("n"), "key")).alias("m")).select(who, F.col("m.key").alias("key"))
    summary = by.join(events, who, "left").join(lead, who, "left").withColumn("self_share", F.round(1 - F.col("corroborated") / F.col("n_docs"), 3))
    months = p.where("date IS NOT NULL").groupBy(who, F.date_format("date", "yyyy-MM").alias("key")).agg(F.count_distinct("doc_id").alias("n_docs"))
    w = W.partitionBy(who).orderBy(F.desc("last_mention_date"), "id")
    recent = about.withColumn("r", F.row_number().over(w)).where(F.col("r") <= newest).select(who, F.col("id").cast("string").alias("key"), F.col("r").cast("long").alias("n_docs"), F.col("material_score").cast("double").alias("mean_score"))
    label = lambda df, name: df.select(F.lit(name).alias("section"), "*")
    return stacked([label(summary.withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long"))), "summary"), label(months, "month"), label(cats, "category"), label(recent, "event")])


def report_metrics(docs: DataFrame, rc: DataFrame, cat: DataFrame, sub: DataFrame, events: DataFrame, recipients: Sequence[str]) -> DataFrame:
    """section, key, n_docs, corroborated, share of a report window. docs: doc_id, initiating_country, source_geofocus of one initiator; events: material_score. The share of a recipient is that of
    its corroborated documents (the provenance quadrant)."""
    d = third_party(docs).select("doc_id", "initiating_country", "third").distinct()
    own = rc.where(F.col("recipient_country").isin(*recipients))
    bins = F.least(F.floor(F.coalesce("material_score", F.lit(0))), F.lit(9)).cast("long")
    scores = events.groupBy(F.concat(bins.cast("string"), F.lit("-"), (bins + 1).cast("string")).alias("key")).agg(F.count("*").alias("n_docs"))
    every = docs.sparkSession.range(10).select(F.concat(F.col("id").cast("string"), F.lit("-"), (F.col("id") + 1).cast("string")).alias("key"))
    scores = every.join(scores, "key", "left").select(F.lit("materiality").alias("section"), "key", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"))
    out = stacked([
        section(d, "total", F.lit("documents")),
        section(d.join(cat, "doc_id"), "category", F.col("category")),
        section(d.join(sub, "doc_id"), "subcategory", C.clean_subcategory(F.col("subcategory"))),
        section(d.join(own, "doc_id").where("recipient_country <> initiating_country"), "recipient", F.col("recipient_country"), k=20),
        scores,
    ])
    share = F.when(F.col("section").isin("total", "recipient"), F.round(F.col("corroborated") / F.col("n_docs"), 3))
    return out.withColumn("share", share)


def entity_profile(entity: str, cen: DataFrame, edges: DataFrame, den: DataFrame, events: DataFrame, k: int = 20) -> DataFrame:
    """section, key, n, day of one entity: totals, its k strongest edges in either direction, up to k events by their last day, and documents by month. edges: a, b, weight, last_day;
    events: entity, master, last_day."""
    one = lambda df, c="entity": df.where(F.col(c) == entity)
    label = lambda df, name, key, n, day: df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"), day.alias("day"))
    none = F.lit(None).cast("date")
    best = lambda df, other: df.orderBy(F.desc("weight"), other).limit(k)
    return stacked([
        label(one(cen), "profile", F.lit("documents"), F.col("total_documents"), F.col("last_mention_date")),
        label(best(one(edges, "a"), "b"), "outgoing", F.col("b"), F.col("weight"), F.col("last_day")),
        label(best(one(edges, "b"), "a"), "incoming", F.col("a"), F.col("weight"), F.col("last_day")),
        label(one(events).orderBy(F.desc("last_day"), "master").limit(k), "event", F.col("master"), F.lit(None), F.col("last_day")),
        label(one(den).groupBy(F.trunc("mention_date", "month").alias("m")).agg(F.count_distinct("mention_date", "doc_id").alias("n")), "month", F.date_format("m", "yyyy-MM"), F.col("n"), none),
    ])


def rollup(docs: DataFrame, keys: Sequence[str], dims: dict[str, tuple[DataFrame, str, int | None]], scores: DataFrame, least: int = 1) -> DataFrame:
    """Of all groups in one pass: keys, section, key, n, and for section `total` first and last day, mean and median score. docs: keys, doc_id, date, source_name. dims: section -> (bridge, column,
    how many of the largest). scores: keys, period_type, material_score, of the group's events; bins are half points, half to even."""
    keys = list(keys)
    one = docs.groupBy(*keys, "doc_id").agg(F.min("date").alias("date"), F.min("source_name").alias("source_name"))
    # groups, sources and months are sums over these, so documents are read once for the three
    cells = one.groupBy(*keys, "source_name", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    cells, _ = written(cells, "cells")
    g = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).where(F.col("n") >= least)

    def counted(df: DataFrame, name: str, key: Column, k: int | None = None, n: Column | None = None) -> DataFrame:
        c = df.groupBy(*keys, key.cast("string").alias("key")).agg((n if n is not None else F.count("*")).alias("n")).where("key IS NOT NULL")
        # groups are chosen after counting: few rows meet then
        c = c.join(g.select(*keys), keys, "left_semi")
        if k:
            c = c.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "key"))).where(F.col("r") <= k).drop("r")
        return c.select(*keys, F.lit(name).alias("section"), "key", "n")

    s = scores.withColumn("s", F.col("material_score").cast("double")).groupBy(*keys, "period_type", "s").agg(F.count("*").alias("n"))
    s, _ = written(s, "scores")  # three sections ask it
    stats = s.groupBy(*keys).agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum(F.when(F.col("s").isNotNull(), F.col("n"))), 6).alias("mean_score"), F.percentile("s", F.lit(0.5), F.col("n")).alias("median_score"))
    total = g.join(stats, keys, "left").select(*keys, F.lit("total").alias("section"), F.lit("documents").alias("key"), "n", "first_day", "last_day", "mean_score", "median_score")
    return stacked([
        total,
        *[counted(one.select(*keys, "doc_id").join(b, "doc_id"), name, F.col(c), k) for name, (b, c, k) in dims.items()],
        counted(cells, "source", F.col("source_name"), 30, F.sum("n")),
        counted(cells, "month", F.col("month"), n=F.sum("n")),
        counted(s, "events", F.col("period_type"), n=F.sum("n")),
        counted(s.where("s IS NOT NULL"), "score", (F.bround(F.col("s") * 2) / 2).cast("decimal(3,1)"), n=F.sum("n")),
    ])


def event_evidence(name: str, ce: DataFrame, event_docs: DataFrame, d: DataFrame, most: int = 60) -> DataFrame:
    """section, key, n_docs, day, snippet, self_reported: the event of that name (exactly, else one that contains it) with most articles, its sources, and its newest documents."""
    tier = F.when(F.col("canonical_name") == name, 1).when(F.col("canonical_name").ilike(f"%{name}%"), 2)
    one = ce.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.desc("total_articles"), "id").limit(1)
    one = one.select(F.col("id").alias("canonical_event_id"), "initiating_country", "total_articles", "last_mention_date")
    docs = event_docs.join(F.broadcast(one), "canonical_event_id").select("doc_id", "initiating_country").distinct().join(d.select("doc_id", "date", "source_name", "source_geofocus", "distilled_text"), "doc_id")
    docs = self_flags(docs).withColumn("self_reported", F.coalesce("self_reported", F.lit(False)))
    source = docs.groupBy(F.coalesce("source_name", F.lit("(unknown)")).alias("key")).agg(F.count("*").alias("n_docs"), F.max("self_reported").alias("self_reported")).orderBy(F.desc("n_docs"), "key").limit(15)
    shown = docs.orderBy(F.desc_nulls_last("date"), "doc_id").limit(most).select(F.col("doc_id").cast("string").alias("key"), F.col("date").alias("day"), F.substring("distilled_text", 1, 320).alias("snippet"), "self_reported")
    totals = docs.agg(F.count("*").alias("documents"), F.count_if(~F.col("self_reported")).alias("third-party documents"), F.count_distinct(F.coalesce("source_name", F.lit("(unknown)"))).alias("sources"))
    totals = totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("key", "n_docs"))
    event = one.select(F.col("canonical_event_id").cast("string").alias("key"), F.col("total_articles").alias("n_docs"), F.col("last_mention_date").alias("day"))
    label = lambda df, s: df.select(F.lit(s).alias("section"), "*")
    return stacked([label(event, "event"), label(totals, "total"), label(source, "source"), label(shown, "document")])


def top_keys(counts: DataFrame, k: int, name: str) -> DataFrame:
    """counts: id, key, n -> id and the k largest keys in order, as an array; ties go to the smaller key."""
    best = counts.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))), 1, k).alias("b"))
    return best.select("id", F.transform("b", lambda x: x["key"]).alias(name))


def validation_report(parsed: DataFrame, rejects: DataFrame, existing: DataFrame, dims: dict[str, str], k: int = 5) -> DataFrame:
    """metric, key, n, day of a batch before it is taken in. parsed: doc_id, date and the columns of dims; rejects: reason; existing: doc_id."""
    ids = parsed.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("date").alias("date"))
    known = ids.join(existing.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    bad = rejects.groupBy(F.col("reason").alias("key")).agg(F.count("*").alias("n"))
    g = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("parseable"), F.count_if(F.col("known").isNull()).alias("new"), F.count_if("known").alias("existing"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates in file"), F.count_if(F.col("date").isNull()).alias("without date"))
    g = g.crossJoin(rejects.agg(F.count("*").alias("errors"))).withColumn("total", F.col("parseable") + F.col("errors"))  # one row each
    names = ["total", "parseable", "errors", "new", "existing", "duplicates in file", "without date"]
    counts = g.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("long"))])).alias("metric", "n"))
    span = parsed.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = [span.select(F.lit("date range").alias("metric"), F.lit(c).alias("key"), F.col(c).alias("day")) for c in ("first", "last")]
    top = [parsed.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).where("key IS NOT NULL").orderBy(F.desc("n"), "key").limit(k).select(F.lit(f"top {name}").alias("metric"), "key", "n") for name, c in dims.items()]
    warn = counts.where("metric IN ('errors', 'duplicates in file', 'existing', 'without date') AND n > 0").select(F.lit("warning").alias("metric"), F.col("metric").alias("key"), "n")
    return stacked([counts, *days, *top, bad.select(F.lit("error").alias("metric"), "key", "n"), warn])
