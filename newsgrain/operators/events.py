"""Canonical events: families, trends, merging, summaries over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .store import forget, written


def event_family(ce: DataFrame) -> DataFrame:
    """Each event with its master. The `child of, or itself` condition is one equi key, coalesce(master, id)."""
    return ce.select("id", F.coalesce("master_event_id", "id").alias("master"))


def family_docs(ce: DataFrame, event_docs: DataFrame) -> DataFrame:
    """Distinct (master, day, document) over whole families."""
    return event_docs.join(event_family(ce).withColumnRenamed("id", "canonical_event_id"), "canonical_event_id").select("master", "mention_date", "doc_id").distinct()


def filtered(docs: DataFrame, rc: DataFrame, cat: DataFrame, sub: DataFrame | None, recipients: Sequence[str], categories: Sequence[str], subcategories: Sequence[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """Family documents in a date range that have a listed recipient and category (and subcategory): semi joins."""
    if start:
        docs = docs.where(F.col("mention_date") >= F.lit(start).cast("date"))
    if end:
        docs = docs.where(F.col("mention_date") <= F.lit(end).cast("date"))
    for b, c, v in ((rc, "recipient_country", recipients), (cat, "category", categories), (sub, "subcategory", subcategories)):
        if b is not None and v:
            docs = docs.join(b.where(F.col(c).isin(*v)).select("doc_id"), "doc_id", "left_semi")
    return docs


def masters(ce: DataFrame) -> DataFrame:
    return ce.where("master_event_id IS NULL")


def children(ce: DataFrame) -> DataFrame:
    return ce.where("master_event_id IS NOT NULL").groupBy(F.col("master_event_id").alias("id")).agg(F.count("*").alias("n_children"))


def master_event_overview(ce: DataFrame, docs: DataFrame) -> DataFrame:
    """Masters with child count, filtered distinct documents, first and last day."""
    g = docs.groupBy(F.col("master").alias("id")).agg(F.count_distinct("doc_id").alias("n_docs"), F.min("mention_date").alias("first_day"), F.max("mention_date").alias("last_day"))
    return masters(ce).select("id", "canonical_name", "initiating_country").join(children(ce), "id", "left").join(g, "id", "left").select("id", "canonical_name", "initiating_country", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_day", "last_day")


def top_master_events(ce: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    o = master_event_overview(ce, docs).withColumn("days_span", F.datediff("last_day", "first_day").cast("long"))
    return o.orderBy(F.desc("n_docs"), "id").limit(k)


def events_by_country(ce: DataFrame, docs: DataFrame, reference_fanout: bool = False) -> DataFrame:
    """Masters, children and sum of filtered documents by initiator. reference_fanout multiplies a master's documents by its children, as a join before the sum does."""
    o = master_event_overview(ce, docs)
    n = F.col("n_docs") * F.greatest("n_children", F.lit(1)) if reference_fanout else F.col("n_docs")
    return o.groupBy("initiating_country").agg(F.count("*").alias("n_masters"), F.sum("n_children").alias("n_children"), F.sum(n).alias("n_docs"))


def standalone_events(ce: DataFrame, docs: DataFrame) -> DataFrame:
    return master_event_overview(ce, docs).where("n_children = 0").select("id", "canonical_name", "n_docs")


def event_daily_trend(docs: DataFrame) -> DataFrame:
    return docs.groupBy("mention_date").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("master").alias("n_events"))


def dim_impact(docs: DataFrame, bridge: DataFrame, column: str) -> DataFrame:
    """Distinct documents by (master, dim), then their sum and the number of masters by dim."""
    g = docs.select("master", "doc_id").distinct().join(bridge, "doc_id").groupBy("master", column).agg(F.count("*").alias("n"))
    return g.groupBy(column).agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_events"))


def event_timeline_daily(ce: DataFrame, dem: DataFrame, master: int) -> DataFrame:
    one = event_family(ce).where(F.col("master") == master).withColumnRenamed("id", "canonical_event_id")
    return dem.join(one, "canonical_event_id").select("canonical_event_id", "mention_date", "article_count", F.size("doc_ids").cast("long").alias("n_docs"))


def event_scope(ce_maps: DataFrame, *, start: str, end: str, initiator: str | None = None, recipient: str | None = None, category: str | None = None) -> DataFrame:
    """Masters whose span overlaps [start, end]; the recipient must be the dominant key, the category any key."""
    e = masters(ce_maps).where((F.col("first_mention_date") <= F.lit(end).cast("date")) & (F.col("last_mention_date") >= F.lit(start).cast("date")))
    e = e.where(F.col("initiating_country") == initiator) if initiator else e
    e = e.where(C.dominant_key(F.col("primary_recipients")) == recipient) if recipient else e
    return e.where(F.map_contains_key("primary_categories", F.lit(category))) if category else e


def with_phase(ce: DataFrame) -> DataFrame:
    """story_phase against the newest mention of the corpus."""
    ref = ce.agg(F.max("last_mention_date").alias("ref"))
    return ce.crossJoin(F.broadcast(ref)).withColumn("phase", C.story_phase(F.col("first_mention_date"), F.col("last_mention_date"), F.col("total_articles"), F.col("total_mention_days"), F.col("ref"))).drop("ref")  # one row


def materiality_stats(ce: DataFrame) -> DataFrame:
    s = F.col("material_score").cast("double")
    band = C.materiality_band(F.col("material_score"))
    return ce.agg(F.count("*").alias("n"), F.round(F.avg(s), 2).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"), F.min(s).alias("lowest"), F.max(s).alias("highest"), *[F.count_if(band == b).alias(b) for b in ("symbolic", "developing", "substantive", "unscored")])


def score_histogram(ce: DataFrame) -> DataFrame:
    return ce.where("material_score IS NOT NULL").groupBy(F.floor("material_score").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def materiality_filter(ce: DataFrame, band: str, k: int) -> DataFrame:
    """Events of a band; symbolic ones by articles and recency, others by score."""
    lo, hi = C.band_bounds(band)
    s = F.col("material_score")
    e = ce.where(s.isNotNull())
    e = e.where(s >= lo) if lo is not None else e
    e = e.where(s < hi) if hi is not None else e
    order = [F.desc("total_articles"), F.desc("last_mention_date"), F.asc("id")] if band == "symbolic" else [F.desc("material_score"), F.desc("total_articles"), F.asc("id")]
    return e.orderBy(*order).limit(k)


def event_rank_composite(ce: DataFrame, k: int) -> DataFrame:
    v = F.round(F.coalesce(F.col("material_score").cast("double"), F.lit(0.0)) * F.ln(F.col("total_articles") + 1), 6)
    return ce.withColumn("rank_value", v).orderBy(F.desc("rank_value"), F.desc("total_articles"), F.desc("last_mention_date"), "id").limit(k).select("id", "rank_value")


def merge_canonical_events(ce: DataFrame, event_docs: DataFrame) -> DataFrame:
    """Masters after taking over their children's mentions: statistics over the union of documents, and reference_counts over the sum of article counts. Peak day ties go to the earliest."""
    fam = event_family(ce).withColumnRenamed("id", "canonical_event_id")
    days = event_docs.groupBy("canonical_event_id", "mention_date").agg(F.count("*").alias("n")).join(fam, "canonical_event_id").groupBy("master", "mention_date").agg(F.sum("n").alias("articles"))
    union = family_docs(ce, event_docs).groupBy("master", "mention_date").agg(F.count("*").alias("docs"))
    g = days.join(union, ["master", "mention_date"]).groupBy("master").agg(
        F.count("*").alias("mention_days"), F.min("mention_date").alias("first_day"), F.max("mention_date").alias("last_day"), F.sum("docs").alias("total_docs"), F.sum("articles").alias("reference_counts"),
        F.min(F.struct((-F.col("articles")).alias("a"), "mention_date")).alias("peak"),
    )
    return g.select(F.col("master").alias("id"), "mention_days", "first_day", "last_day", "total_docs", "reference_counts", F.col("peak.mention_date").alias("peak_day"), (-F.col("peak.a")).alias("peak_articles"))


def refresh_event_stats(ce: DataFrame, event_docs: DataFrame) -> DataFrame:
    """Events whose stored totals differ from their mentions."""
    g = event_docs.groupBy("canonical_event_id", "mention_date").count().groupBy(F.col("canonical_event_id").alias("id")).agg(F.sum("count").alias("articles"), F.count("*").alias("days"), F.min("mention_date").alias("first_day"), F.max("mention_date").alias("last_day"))
    j = ce.join(g, "id", "left")
    wrong = ~(F.col("total_articles").eqNullSafe(F.col("articles")) & F.col("total_mention_days").eqNullSafe(F.col("days")) & F.col("first_mention_date").eqNullSafe(F.col("first_day")) & F.col("last_mention_date").eqNullSafe(F.col("last_day")))
    return j.where(wrong).select("id", "articles", "days", "first_day", "last_day")


def split_candidates(ce: DataFrame, min_span: int, k: int, by: str = "articles") -> DataFrame:
    e = ce.withColumn("span_days", F.datediff("last_mention_date", "first_mention_date").cast("long")).where(F.col("span_days") > min_span)
    return e.orderBy(F.desc("total_articles" if by == "articles" else "span_days"), "id").limit(k).select("id", "span_days", "total_articles")


def days_gap(dem: DataFrame) -> DataFrame:
    w = W.partitionBy("canonical_event_id").orderBy("mention_date")
    return dem.select("canonical_event_id", "mention_date", F.datediff("mention_date", F.lag("mention_date").over(w)).cast("long").alias("gap"))


def rollup_period(es: DataFrame, links: DataFrame, ranges: DataFrame, unit: str) -> DataFrame:
    """Lower-level summaries fully inside a period, grouped by (initiator, event name); documents are the distinct union of their links. ranges: period_start, period_end."""
    low = es.select("es_id", "event_name", "initiating_country", F.col("period_start").alias("s"), F.col("period_end").alias("e"))
    p = ranges.select("period_start", "period_end")
    # ranges do not overlap, so the one that holds the start is found by the unit's truncated start
    key = F.trunc("s", unit)
    inside = low.withColumn("k", key).join(p.withColumn("k", F.trunc("period_start", unit)), "k").where("s >= period_start AND e <= period_end")
    g = inside.groupBy("initiating_country", "event_name", "period_start", "period_end").agg(F.min("s").alias("first_observed"), F.max("e").alias("last_observed"), F.count("*").alias("n_parts"))
    n = inside.select("es_id", "initiating_country", "event_name", "period_start").join(links, "es_id").groupBy("initiating_country", "event_name", "period_start").agg(F.count_distinct("doc_id").alias("n_docs"))
    return g.join(n, ["initiating_country", "event_name", "period_start"], "left")


def ranges_of(span: DataFrame, unit: str) -> DataFrame:
    """Weeks from Monday, months or years that meet [s, e], clipped to it; span: one row of s and e."""
    step = {"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    last = {"week": F.date_add("p", 6), "month": F.last_day("p"), "year": F.date_sub(F.add_months("p", 12), 1)}[unit]
    return span.select("s", "e", F.explode(F.sequence(F.trunc("s", unit), F.col("e"), F.expr(step))).alias("p")).select(F.greatest("p", "s").alias("period_start"), F.least(last, F.col("e")).alias("period_end"))


def period_ranges(spark, start: str, end: str, unit: str) -> DataFrame:
    return ranges_of(spark.range(1).select(F.lit(start).cast("date").alias("s"), F.lit(end).cast("date").alias("e")), unit)


def backfill_links(high: DataFrame, links: DataFrame, low: DataFrame, low_links: DataFrame) -> DataFrame:
    """Links (es_id, doc_id) for those period summaries that have none: the documents of the lower summaries of the same name and initiator inside the period."""
    bare = high.join(links.select("es_id").distinct(), "es_id", "left_anti").select("es_id", "event_name", "initiating_country", "period_start", "period_end")
    part = low.select(F.col("es_id").alias("low_id"), "event_name", "initiating_country", F.col("period_start").alias("s"), F.col("period_end").alias("e"))
    inside = bare.join(part, ["event_name", "initiating_country"]).where("s >= period_start AND e <= period_end").select("es_id", "low_id")
    return inside.join(low_links.withColumnRenamed("es_id", "low_id"), "low_id").select("es_id", "doc_id").distinct()


def event_source_links(links: DataFrame, d: DataFrame, newest: int = 5) -> DataFrame:
    """Weight 1.0 for the newest documents of a summary, else 0.5."""
    w = W.partitionBy("es_id").orderBy(F.desc("date"), "doc_id")
    return links.join(d.select("doc_id", "date"), "doc_id").select("es_id", "doc_id", F.when(F.row_number().over(w) <= newest, 1.0).otherwise(0.5).alias("contribution_weight"))


def latest_per_key(es: DataFrame, k: int | None = None) -> DataFrame:
    """Newest summary for each linked event, or each normalised name and country where the link is missing."""
    key = F.coalesce(F.col("canonical_event_id").cast("string"), F.concat(F.lower(F.trim("event_name")), F.lit("|"), "initiating_country"))
    w = W.partitionBy("key").orderBy(F.desc("period_start"), "es_id")
    out = es.withColumn("key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "key")
    return out if k is None else out.orderBy(F.desc("period_start"), F.desc("total_documents"), "es_id").limit(k)


def with_narrative(es: DataFrame) -> DataFrame:
    """overview and outcomes from the JSON column `narrative`, whichever of the periods' keys holds them."""
    first = lambda *keys: F.coalesce(*[F.get_json_object("narrative", f"$.{k}") for k in keys], F.lit(""))
    return es.withColumns({"overview": first("overview", "monthly_overview", "yearly_overview"), "outcomes": first("outcomes", "key_outcomes", "annual_outcomes")})


def search_summaries(es: DataFrame, term: str, k: int) -> DataFrame:
    """The largest summaries that hold the term in name, overview or outcomes, and where it was found first."""
    at = lambda c: F.col(c).ilike(f"%{term}%")
    found = F.when(at("event_name"), "name").when(at("overview"), "overview").when(at("outcomes"), "outcomes")
    return es.withColumn("found_in", found).where("found_in IS NOT NULL").orderBy(F.desc("total_documents"), "es_id").limit(k).select("es_id", "total_documents", "found_in")


def intelligence_feed(es: DataFrame, ce: DataFrame, overall: int = 10, by_actor: int = 5) -> DataFrame:
    """The newest summaries without repeats of an event, overall and by actor, with missing event links resolved by name."""
    newest = latest_per_key(es)
    newest = newest.drop("canonical_event_id").join(resolve_missing_event_link(newest, ce), "es_id")
    order = [F.desc("period_start"), F.desc("total_documents"), F.asc("es_id")]
    columns = ["es_id", "initiating_country", "period_start", "total_documents", "canonical_event_id"]
    top = newest.orderBy(*order).limit(overall).select(F.lit("overall").alias("section"), *columns)
    each = newest.withColumn("r", F.row_number().over(W.partitionBy("initiating_country").orderBy(*order))).where(F.col("r") <= by_actor)
    return top.unionByName(each.select(F.lit("by actor").alias("section"), *columns))


def strategic_context(es: DataFrame, recipients: DataFrame, categories: DataFrame, k: int = 5) -> DataFrame:
    """section, es_id, initiating_country, about, total_documents: the newest summary of each (actor, recipient) and (actor, category), and the k largest about each recipient.
    recipients, categories: id, key of the summaries' events."""
    s = es.select("es_id", "initiating_country", "period_start", "total_documents", F.col("canonical_event_id").alias("id"))
    newest, largest = [F.desc("period_start"), F.asc("es_id")], [F.desc("total_documents"), F.asc("es_id")]

    def best(df: DataFrame, name: str, keys: list[str], order: list[Column], most: int) -> DataFrame:
        one = df.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= most)
        return one.select(F.lit(name).alias("section"), "es_id", "initiating_country", "about", "total_documents")

    with_r, with_c = (s.join(x.select("id", F.col("key").alias("about")).distinct(), "id") for x in (recipients, categories))
    actor = ["initiating_country", "about"]
    return best(with_r, "pair", actor, newest, 1).unionByName(best(with_c, "category", actor, newest, 1)).unionByName(best(with_r, "recipient", ["about"], largest, k))


def asof_latest_narrative(es: DataFrame) -> DataFrame:
    return es.groupBy("event_name", "initiating_country").agg(F.max_by(F.struct("es_id", "period_start"), F.struct("period_start", "es_id")).alias("l")).select("event_name", "initiating_country", F.col("l.es_id").alias("es_id"), F.col("l.period_start").alias("period_start"))


def resolve_missing_event_link(es: DataFrame, ce: DataFrame) -> DataFrame:
    """Fill a null link by (name, initiator) among masters, the smallest id on ties."""
    m = masters(ce).groupBy(F.col("canonical_name").alias("event_name"), "initiating_country").agg(F.min("id").alias("found"))
    return es.join(m, ["event_name", "initiating_country"], "left").select("es_id", F.coalesce("canonical_event_id", "found").alias("canonical_event_id"))


def summary_statistics(es: DataFrame) -> DataFrame:
    return es.agg(F.count("*").alias("n"), F.count_distinct("event_name").alias("n_names"), F.count_distinct("initiating_country").alias("n_countries"), F.sum("total_documents").alias("n_docs"), F.round(F.avg(F.col("material_score").cast("double")), 6).alias("mean_score"), F.min("period_start").alias("first_day"), F.max("period_end").alias("last_day"))


def top_events_by_period(es: DataFrame, start: str, end: str, k: int) -> DataFrame:
    g = es.where(F.col("period_start").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("event_name").agg(F.count_distinct("period_start").alias("n_days"), F.sum("total_documents").alias("n_docs"), F.min("period_start").alias("first_day"), F.max("period_start").alias("last_day"))
    return g.orderBy(F.desc("n_docs"), "event_name").limit(k)


def lookback_matches(report: DataFrame, old: DataFrame, names: DataFrame, categories: DataFrame, recipients: DataFrame, order: Sequence[str], most: int = 200, per_category: int = 10, shown: int = 5) -> DataFrame:
    """tier, report_id, match_id, place: earlier events for report events, in three tiers; an event that a tier has matched is not matched again, and each belongs to one report event.

    report, old: id, master_event_id, initiating_country, material_score; report also category. Tier 1: the same master chain, the smallest report id. Tier 2: the `most` best masters of a country that
    share two names with a report event (names: id, entity). Tier 3: category by category in `order`, at most per_category masters with that category and one of the recipients of the report's events
    in it, for its report event with the highest score (categories, recipients: id, key). place: by score, the `shown` best of each report event."""
    country = "initiating_country"
    chain = F.coalesce("master_event_id", "id")
    best = lambda *keys: W.partitionBy(*keys).orderBy(F.desc_nulls_last("material_score"), "id")
    # every tier asks these again
    ids = report.select("id").unionByName(old.select("id"))
    held = [written(x, "lookback") for x in (report, old, categories.join(ids, "id", "left_semi"), recipients.join(ids, "id", "left_semi"))]
    report, old, categories, recipients = (x for x, _ in held)
    places = [at for _, at in held]

    def kept(found: DataFrame) -> DataFrame:
        found, at = written(found, "lookback")
        places.append(at)
        return found

    r1 = report.select(F.col("id").alias("report_id"), chain.alias("chain"), country)
    found = old.withColumn("chain", chain).join(r1, ["chain", country]).groupBy(F.col("id").alias("match_id")).agg(F.min("report_id").alias("report_id")).withColumn("tier", F.lit(1))
    masters_ = old.where("master_event_id IS NULL")
    free = lambda df, known: df.join(known.select(F.col("match_id").alias("id")), "id", "left_anti")

    second = free(masters_, found).withColumn("k", F.row_number().over(best(country))).where(F.col("k") <= most).select("id", country)
    theirs = report.select(F.col("id").alias("report_id"), F.col(country).alias("c")).join(names.select(F.col("id").alias("report_id"), "entity").distinct(), "report_id")
    shared = second.join(names.select("id", "entity").distinct(), "id").join(theirs, "entity").where(F.col("c") == F.col(country))
    shared = shared.groupBy(F.col("id").alias("match_id"), "report_id").agg(F.count("*").alias("n")).where("n >= 2")
    found = kept(found.unionByName(shared.groupBy("match_id").agg(F.min("report_id").alias("report_id")).withColumn("tier", F.lit(2))))

    for category in order:
        mine = report.where(F.col("category") == category)
        about = mine.select("id", country).join(recipients, "id").select(country, "key").distinct()
        target = mine.groupBy(country).agg(F.min(F.struct((-F.coalesce("material_score", F.lit(0))).alias("s"), "id")).alias("t")).select(country, F.col("t.id").alias("report_id"))
        fit = free(masters_, found).join(categories.where(F.col("key") == category).select("id"), "id", "left_semi")
        fit = fit.join(recipients, "id").join(about, [country, "key"], "left_semi").select("id", country, "material_score").distinct()
        third = fit.withColumn("k", F.row_number().over(best(country))).where(F.col("k") <= per_category).join(target, country)
        found = kept(found.unionByName(third.select(F.col("id").alias("match_id"), "report_id", F.lit(3).alias("tier"))))
    scored = found.join(old.select(F.col("id").alias("match_id"), "material_score"), "match_id")
    place = F.row_number().over(W.partitionBy("report_id").orderBy(F.desc_nulls_last("material_score"), "match_id"))
    out, _ = written(scored.withColumn("place", place).where(F.col("place") <= shown).select("tier", "report_id", "match_id", "place"), "lookback")
    forget(out.sparkSession, *places)
    return out


def score_bins(ce: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram in half-point bins, half to even, with mean and median."""
    s = F.col("material_score").cast("double")
    return ce.where("material_score IS NOT NULL").groupBy(*keys, (F.bround(s * 2) / 2).alias("bin")).agg(F.count("*").alias("n"))


def assign_best_category(event_docs: DataFrame, cat: DataFrame) -> DataFrame:
    """Each event to the category with most of its documents, smaller name on ties, if it has at least max(2, a quarter) of them."""
    n = event_docs.groupBy("canonical_event_id").agg(F.count_distinct("doc_id").alias("all_docs"))
    g = event_docs.select("canonical_event_id", "doc_id").distinct().join(cat, "doc_id").groupBy("canonical_event_id", "category").agg(F.count("*").alias("n_docs")).join(n, "canonical_event_id")
    g = g.where(F.col("n_docs") >= F.greatest(F.lit(2), F.ceil(F.col("all_docs") * 0.25)))
    w = W.partitionBy("canonical_event_id").orderBy(F.desc("n_docs"), "category")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("canonical_event_id", "category", "n_docs", "all_docs")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
