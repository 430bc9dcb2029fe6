"""Provenance-aware facts: report base, intensity, ledger, concentration and competition measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..scope import Scope
from .counts import count_docs, scope_pairs


def report_base(d: DataFrame, ic: DataFrame, rc: DataFrame, cat: DataFrame, scope: Scope) -> DataFrame:
    """Document x initiator x recipient x category in scope, with month and provenance flags (null for a null geofocus)."""
    base = scope_pairs(d, ic, rc, scope).join(cat.where(F.col("category").isin(*scope.categories)), "doc_id")
    geo = F.col("source_geofocus")
    return base.select("doc_id", "date", F.trunc("date", "month").alias("month"), "initiating_country", "recipient_country", "category", "source_name", "source_geofocus", C.self_reported(geo, F.col("initiating_country")).alias("self_reported"), C.self_reported(geo, F.col("recipient_country")).alias("recipient_focused"))


def partner_report_base(d: DataFrame, ic: DataFrame, rc: DataFrame, cat: DataFrame, scope: Scope, initiator: str, adversaries: Sequence[str], partners: Sequence[str]) -> DataFrame:
    one = Scope((initiator,), scope.recipients, scope.categories, start=scope.start, end=scope.end)
    b = report_base(d, ic, rc, cat, one)
    return b.drop("self_reported", "recipient_focused", "initiating_country").withColumn("framing", C.framing_class(F.col("source_geofocus"), adversaries, partners))


def by_doc(base: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row for (dims, document): later sums need no distinct counts. The flags belong to the document and the dims."""
    return base.groupBy(*dims, "doc_id").agg(F.max(F.col("self_reported").cast("int")).alias("s"), F.min(F.col("self_reported").cast("int")).alias("s0"), F.max(F.col("recipient_focused").cast("int")).alias("r"))


def provenance_intensity(base: DataFrame, null_policy: str = "drop") -> DataFrame:
    """Raw, self-reported, third-party and recipient-focused documents by initiator, recipient, category and month. A null geofocus is neither (drop) or third-party."""
    dims = ["initiating_country", "recipient_country", "category", "month"]
    one = base.groupBy(*dims, "doc_id", "source_name", "self_reported", "recipient_focused").agg(F.lit(1).alias("one"))
    third = F.col("self_reported") == F.lit(False) if null_policy == "drop" else ~F.coalesce(F.col("self_reported"), F.lit(False))
    # a document has one source and one geofocus, so within the dims each document is one row
    g = one.groupBy(*dims).agg(F.count("*").alias("raw_docs"), F.count_if("self_reported").alias("self_docs"), F.count_if(third).alias("third_docs"), F.count_if("recipient_focused").alias("recipient_focused_docs"), F.count_distinct("source_name").alias("distinct_sources"))
    return g.withColumn("self_share", F.round(F.col("self_docs") / F.nullif("raw_docs", F.lit(0)), 3)).withColumn("normalized", F.col("third_docs"))


def actor_tensor(pi: DataFrame) -> DataFrame:
    return pi.groupBy("initiating_country", "category", "month").agg(*[F.sum(c).alias(c) for c in ("raw_docs", "self_docs", "third_docs", "distinct_sources")])


def provenance_stats(base: DataFrame, actor: str, recipient: str | None = None) -> DataFrame:
    """Per category of an actor; a null geofocus counts as third-party."""
    b = base.where(F.col("initiating_country") == actor)
    b = b.where(F.col("recipient_country") == recipient) if recipient else b
    g = b.groupBy("category", "doc_id").agg(F.coalesce(F.max("self_reported"), F.lit(False)).alias("s")).groupBy("category").agg(F.count("*").alias("raw_docs"), F.count_if("s").alias("self_docs"))
    return g.withColumn("third_docs", F.col("raw_docs") - F.col("self_docs"))


def source_provenance_map(d: DataFrame) -> DataFrame:
    """The commonest geofocus of each source, the smallest on ties, and its documents."""
    return d.groupBy("source_name").agg(F.count("*").alias("n_docs"), F.expr("mode() WITHIN GROUP (ORDER BY source_geofocus)").alias("dominant_geofocus"))


def canon_recipient(df: DataFrame, column: str, aliases: dict[str, str], known: Sequence[str]) -> DataFrame:
    """canonical by alias map, and an error for names that are neither alias nor known."""
    spark = df.sparkSession
    a = spark.createDataFrame(sorted({**{k: k for k in known}, **aliases}.items()), "alias string, canonical string")
    out = df.join(F.broadcast(a), F.col(column) == F.col("alias"), "left").drop("alias")  # the size of a constant
    return out.withColumn("error", F.when(F.col("canonical").isNull() & F.col(column).isNotNull(), F.concat(F.lit("unknown: "), column)))


def initiative_ledger(ce: DataFrame, event_docs: DataFrame, recipient_counts: DataFrame, d: DataFrame, scope: Scope) -> DataFrame:
    """Events with at least one aliased recipient that is not the initiator: span, recipients, mentions, documents by provenance (null geofocus: third-party), corroboration."""
    e = ce.where(F.col("initiating_country").isin(*scope.influencers)).select("id", "initiating_country", "canonical_name", "first_mention_date", "last_mention_date", "total_articles", "material_score")
    r = canon_recipient(recipient_counts, "key", scope.aliases, scope.recipients).where("canonical IS NOT NULL").join(e.select("id", "initiating_country"), "id").where("canonical <> initiating_country")
    r = r.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("canonical")), ",").alias("recipients"), F.sum("n").alias("recipient_mentions"))
    docs = event_docs.select(F.col("canonical_event_id").alias("id"), "doc_id").distinct().join(d.select("doc_id", "source_name", "source_geofocus"), "doc_id").join(e.select("id", "initiating_country"), "id")
    own = F.coalesce(C.self_reported(F.col("source_geofocus"), F.col("initiating_country")), F.lit(False))
    p = docs.groupBy("id").agg(F.count("*").alias("linked_docs"), F.count_if(own).alias("self_docs"), F.count_if(~own).alias("third_docs"), F.count_distinct("source_name").alias("distinct_sources"))
    out = e.join(r, "id").join(p, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("linked_docs", "self_docs", "third_docs", "distinct_sources")}
    return out.withColumns(zero).withColumn("corroboration", F.round(F.col("third_docs") / F.nullif("linked_docs", F.lit(0)), 3))


def initiative_gate(ledger: DataFrame, share: float = 0.5, sources: int = 3, score: float = 6) -> DataFrame:
    ok = (F.col("corroboration") >= share) & (F.col("distinct_sources") >= sources)
    return ledger.groupBy("initiating_country").agg(F.count("*").alias("total"), F.count_if(ok).alias("corroborated"), F.count_if(ok & (F.col("material_score") >= score)).alias("substantive"))


def ledger_rank(ledger: DataFrame, k: int = 18) -> DataFrame:
    """score * ln(1 + sources), the best row of each name, top k."""
    v = F.round(F.coalesce(F.col("material_score").cast("double"), F.lit(0.0)) * F.log1p("distinct_sources"), 6)
    one = ledger.withColumn("rank_value", v).withColumn("_r", F.row_number().over(W.partitionBy("canonical_name").orderBy(F.desc("rank_value"), "id"))).where("_r = 1")
    return one.orderBy(F.desc("rank_value"), "id").limit(k).select("id", "canonical_name", "rank_value")


def geo_intensity(points: DataFrame) -> DataFrame:
    """points: doc_id, initiating_country, self_reported, lat_long, location. Valid `lat,long` snapped to quarter degrees, half away from zero, between 60 south and 75 north. A null geofocus is not
    third-party; the smallest place wins a tie."""
    ok = points.where(F.col("lat_long").rlike(r"^-?[0-9]+(\.[0-9]+)?,\s*-?[0-9]+(\.[0-9]+)?$"))
    cell = lambda k: (F.round(F.trim(F.split_part("lat_long", F.lit(","), F.lit(k))).cast("decimal(18,8)") * 4, 0) / 4).cast("double")
    ok = ok.withColumns({"lat": cell(1), "long": cell(2)}).where("lat BETWEEN -60 AND 75 AND long BETWEEN -180 AND 180")
    # the commonest place is that of the distinct points, as counts are of distinct documents
    one = ok.select("doc_id", "initiating_country", "self_reported", "lat", "long", "location").distinct()
    return one.groupBy("initiating_country", "lat", "long").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(F.when(~F.col("self_reported"), F.col("doc_id"))).alias("third_docs"), F.expr("mode() WITHIN GROUP (ORDER BY location)").alias("place"))


def concentration_hhi(counts: DataFrame, key: str, x: str = "n_docs") -> DataFrame:
    s = counts.withColumn("share", F.col(x) / F.sum(x).over(W.partitionBy(key)))
    return s.groupBy(key).agg(F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"), F.count("*").alias("n"), F.round(F.max("share"), 6).alias("top_share"))


def lorenz_curve(counts: DataFrame, group: str, name: str, x: str = "n_docs") -> DataFrame:
    """Cumulative shares in ascending order of x within each group; starts at (0, 0)."""
    w = W.partitionBy(group).orderBy(x, name)
    run = counts.withColumns({"p": F.row_number().over(w) / F.count("*").over(W.partitionBy(group)), "v": F.sum(x).over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum(x).over(W.partitionBy(group))})
    zero = counts.select(group).distinct().select(group, F.lit(0.0).alias("p"), F.lit(0.0).alias("v"))
    return zero.unionByName(run.select(group, F.round("p", 6).alias("p"), F.round("v", 6).alias("v")))


def hedging_class(totals: DataFrame, lead_share: float = 0.45, ratio: float = 1.4) -> DataFrame:
    """totals: recipient_country, initiating_country, n_docs. Single-patron, contested or balancing by the two leading actors."""
    w = W.partitionBy("recipient_country").orderBy(F.desc("n_docs"), "initiating_country")
    t = totals.withColumns({"r": F.row_number().over(w), "total": F.sum("n_docs").over(W.partitionBy("recipient_country"))})
    g = t.where("r <= 2").groupBy("recipient_country").agg(F.max(F.when(F.col("r") == 1, F.col("initiating_country"))).alias("leader"), F.max(F.when(F.col("r") == 1, F.col("n_docs"))).alias("lead"), F.max(F.when(F.col("r") == 2, F.col("n_docs"))).alias("second"), F.max("total").alias("total"))
    kind = F.when(F.col("lead") / F.col("total") >= lead_share, "single-patron").when(F.col("second").isNotNull() & (F.col("lead") / F.col("second") <= ratio), "contested").otherwise("balancing")
    return g.select("recipient_country", "leader", "lead", "second", "total", kind.alias("hedging"))


def competitive_matrix(base: DataFrame, actors: Sequence[str]) -> DataFrame:
    """Third-party documents, recipients x actors, with the row sum."""
    third = base.where(F.coalesce(F.col("self_reported"), F.lit(False)) == F.lit(False)).select("recipient_country", "initiating_country", "doc_id").distinct()
    p = third.groupBy("recipient_country").pivot("initiating_country", list(actors)).count().na.fill(0)
    return p.withColumn("total", sum((F.col(a) for a in actors), F.lit(0)))


def recipient_profiles(pi: DataFrame) -> DataFrame:
    """Share of each (actor, category) in a recipient's third-party documents."""
    g = pi.groupBy("recipient_country", "initiating_country", "category").agg(F.sum("third_docs").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.nullif(F.sum("n").over(W.partitionBy("recipient_country")), F.lit(0)), 6))


def signature_vs_peers(base: DataFrame) -> DataFrame:
    """An actor's category shares against the mean share of all actors."""
    g = count_docs(base, ["initiating_country", "category"])
    g = g.withColumn("share", F.col("n_docs") / F.sum("n_docs").over(W.partitionBy("initiating_country")))
    return g.select("initiating_country", "category", F.round("share", 6).alias("share"), F.round(F.col("share") - F.avg("share").over(W.partitionBy("category")), 6).alias("vs_peers"))


def tug_of_war(partner: DataFrame, rivals: DataFrame, least: int = 100) -> DataFrame:
    """Per recipient: the partner's documents against the strongest rival's."""
    p = count_docs(partner, ["recipient_country"]).withColumnRenamed("n_docs", "partner_docs")
    r = count_docs(rivals, ["recipient_country", "initiating_country"])
    r = r.groupBy("recipient_country").agg(F.max("n_docs").alias("rival_docs"))
    return p.join(r, "recipient_country").where(F.greatest("partner_docs", "rival_docs") > least)


def framing_share(partner: DataFrame, least: int = 300) -> DataFrame:
    g = count_docs(partner, ["recipient_country", "framing"])
    return g.withColumn("total", F.sum("n_docs").over(W.partitionBy("recipient_country"))).where(F.col("total") > least)


def primary_aligned_events(events: DataFrame, recipient: str, share: float = 0.4) -> DataFrame:
    """Events (with map primary_recipients) that are mainly about the recipient: named in the title, a share of at least 40 %, or the strict maximum."""
    m = F.col("primary_recipients")
    n = F.coalesce(F.try_element_at(m, F.lit(recipient)), F.lit(0))
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    rest = F.map_filter(m, lambda k, v: k != recipient)
    lead = (F.size(rest) == 0) | (n > F.array_max(F.map_values(rest)))
    return events.where((n > 0) & (F.col("canonical_name").contains(recipient) | (n / total >= share) | lead))
