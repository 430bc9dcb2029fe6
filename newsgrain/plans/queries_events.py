"""Queries of canonical events and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import counts as N
from ..operators import events as E
from .model import Model
from .queries_counts import SP, pairs
from .registry import query

FIVE = "('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4')"
FD = f"fd AS (SELECT * FROM fdocs WHERE doc_id IN (SELECT doc_id FROM rc WHERE recipient_country IN {FIVE}) AND doc_id IN (SELECT doc_id FROM cat WHERE category IN {{CAT}}))"
OV = FD + """, o AS (SELECT m.id, m.canonical_name, m.initiating_country, coalesce(c.n, 0) AS n_children, coalesce(g.n, 0) AS n_docs, g.a AS first_day, g.z AS last_day
  FROM ce m LEFT JOIN (SELECT master_event_id AS id, count(*) AS n FROM ce WHERE master_event_id IS NOT NULL
    GROUP BY 1) c ON c.id = m.id LEFT JOIN (SELECT master AS id, count(DISTINCT doc_id) AS n, min(mention_date) AS a, max(mention_date) AS z
    FROM fd GROUP BY 1) g ON g.id = m.id WHERE m.master_event_id IS NULL)"""
U = ("fdocs", "rc", "cat")


def docs(m: Model):
    # documents are chosen while they lie in their buckets, and families are joined afterwards
    return E.family_docs(m.ce, E.filtered(m.event_docs, m.rc, m.cat, None, m.scope.groups["first five"], m.scope.categories))


query("event_family", "SELECT * FROM fam", "fam")(lambda m: E.event_family(m.ce))
query("family_docs_filtered", FD + " SELECT * FROM fd", *U)(docs)
query("master_event_overview", OV + " SELECT * FROM o", *U)(lambda m: E.master_event_overview(m.ce, docs(m)))
query("top_master_events", OV + " SELECT *, CAST(last_day - first_day AS BIGINT) AS days_span FROM o ORDER BY n_docs DESC, id LIMIT 10", *U)(
    lambda m: E.top_master_events(m.ce, docs(m), 10))
query("events_by_country", OV + """ SELECT initiating_country, count(*) AS n_masters, CAST(sum(n_children) AS BIGINT) AS n_children, CAST(sum(n_docs) AS BIGINT) AS n_docs
FROM o GROUP BY 1""", *U)(
    lambda m: E.events_by_country(m.ce, docs(m)))
query("standalone_events", OV + " SELECT id, canonical_name, n_docs FROM o WHERE n_children = 0", *U)(lambda m: E.standalone_events(m.ce, docs(m)))
query("event_daily_trend", FD + " SELECT mention_date, count(DISTINCT doc_id) AS n_docs, count(DISTINCT master) AS n_events FROM fd GROUP BY 1", *U)(
    lambda m: E.event_daily_trend(docs(m)))
for _n, _b, _c in (("recipient_impact", "rc", "recipient_country"), ("event_category_breakdown", "cat", "category")):
    query(_n, FD + f", g AS (SELECT master, {_c}, count(DISTINCT fd.doc_id) AS n FROM fd JOIN {_b} b ON b.doc_id = fd.doc_id GROUP BY 1, 2) SELECT {_c}, CAST(sum(n) AS BIGINT) AS n_docs, count(*) AS n_events FROM g GROUP BY 1", *U)(
    lambda m, b=_b, c=_c: E.dim_impact(docs(m), getattr(m, b), c))
query("event_timeline_daily", "SELECT canonical_event_id, mention_date, article_count, article_count AS n_docs FROM dem WHERE canonical_event_id BETWEEN 10 AND 14", "dem")(
    lambda m: E.event_timeline_daily(m.ce, m.dem, 10))
query("event_detail", "SELECT id, canonical_name, master_event_id, total_articles, total_mention_days FROM ce WHERE id = 10 OR master_event_id = 10", "ce")(
    lambda m: m.ce.join(E.event_family(m.ce).where("master = 10").select("id"), "id", "left_semi")
    .select("id", "canonical_name", "master_event_id", "total_articles", "total_mention_days"))
DOM = "dom AS (SELECT id, key FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, key) AS r FROM rcounts) WHERE r = 1)"
query("dominant_key", DOM + " SELECT id, key AS dominant FROM dom", "rcounts")(
    lambda m: m.ce_maps.where("primary_recipients IS NOT NULL")
    .select("id", C.dominant_key(F.col("primary_recipients")).alias("dominant")))
query("primary_recipient_contains", "SELECT DISTINCT id FROM rcounts WHERE key = 'NATION_2'", "rcounts")(
    lambda m: m.ce_maps.where(F.map_contains_key("primary_recipients", F.lit("NATION_2")))
    .select("id"))
query("recipient_mentions_unpivot", "SELECT ce.id, r.key, r.n FROM ce JOIN rcounts r ON r.id = ce.id WHERE r.key <> ce.initiating_country AND r.key IN {REC}", "ce", "rcounts")(
    lambda m: m.ce_maps.select("id", "initiating_country", F.explode("primary_recipients").alias("key", "n"))
    .where(F.col("key").isin(*m.scope.recipients) & (F.col("key") != F.col("initiating_country")))
    .select("id", "key", "n"))
query("story_phase", """r AS (SELECT max(last_mention_date) AS ref FROM ce) SELECT id, CASE WHEN ref - last_mention_date > 30 THEN 'dormant' WHEN ref - last_mention_date > 14 THEN 'fading' WHEN ref - first_mention_date <= 7 THEN 'emerging' WHEN total_articles >= 5 * greatest(total_mention_days, 1) AND total_mention_days >= 3 THEN 'peak' ELSE 'developing' END AS phase
FROM ce, r""", "ce")(
    lambda m: E.with_phase(m.ce)
    .select("id", "phase"))
BAND = "CASE WHEN material_score IS NULL THEN 'unscored' WHEN material_score < 4 THEN 'symbolic' WHEN material_score < 7 THEN 'developing' ELSE 'substantive' END"
query("materiality_band", f"SELECT id, {BAND} AS band FROM ce", "ce")(lambda m: m.ce.select("id", C.materiality_band(F.col("material_score")).alias("band")))
query("materiality_stats", f"b AS (SELECT CAST(material_score AS DOUBLE) AS s, {BAND} AS b FROM ce WHERE initiating_country = 'NATION_1') SELECT count(*) AS n, round(avg(s), 2) AS mean, quantile_cont(s, 0.5) AS median, min(s) AS lowest, max(s) AS highest, " + ", ".join(f"count(*) FILTER (WHERE b = '{x}') AS {x}" for x in ("symbolic", "developing", "substantive", "unscored")) + " FROM b", "ce")(
    lambda m: E.materiality_stats(m.ce.where("initiating_country = 'NATION_1'")))
query("materiality_histogram", "SELECT CAST(floor(material_score) AS BIGINT) AS bin, count(*) AS n FROM ce WHERE material_score IS NOT NULL GROUP BY 1", "ce")(
    lambda m: E.score_histogram(m.ce))
query("materiality_filter", "SELECT id, total_articles FROM ce WHERE material_score < 4 ORDER BY total_articles DESC, last_mention_date DESC, id LIMIT 10", "ce")(
    lambda m: E.materiality_filter(m.ce, "symbolic", 10)
    .select("id", "total_articles"))
query("materiality_heatmap", """SELECT initiating_country, period_start, count(*) AS n, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean, CAST(max(material_score) AS DOUBLE) AS highest, CAST(sum(total_documents) AS BIGINT) AS n_docs
FROM es WHERE period_start > DATE '2024-02-01' - 365 GROUP BY 1, 2""", "es")(
    lambda m: m.es.where("period_start > date_sub(DATE'2024-02-01', 365)")
    .groupBy("initiating_country", "period_start")
    .agg(F.count("*").alias("n"), F.round(F.avg(F.col("material_score").cast("double")), 6).alias("mean"), F.max(F.col("material_score").cast("double")).alias("highest"), F.sum("total_documents").alias("n_docs"))
)
query("materiality_monthly_matrix", """SELECT initiating_country, CAST(date_trunc('month', period_start) AS DATE) AS month, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean
FROM es GROUP BY 1, 2""", "es")(
    lambda m: m.es.groupBy("initiating_country", F.trunc("period_start", "month").alias("month"))
    .agg(F.round(F.avg(F.col("material_score").cast("double")), 6).alias("mean")))
query("event_rank_composite", """SELECT id, round(coalesce(CAST(material_score AS DOUBLE), 0.0) * ln(total_articles + 1), 6) AS rank_value
FROM ce ORDER BY rank_value DESC, total_articles DESC, last_mention_date DESC, id LIMIT 15""", "ce")(
    lambda m: E.event_rank_composite(m.ce, 15))
query("merge_canonical_events", """a AS (SELECT fam.master, dem.mention_date, CAST(sum(article_count) AS BIGINT) AS articles
  FROM dem JOIN fam ON fam.id = dem.canonical_event_id GROUP BY 1, 2),
b AS (SELECT master, mention_date, count(*) AS docs FROM fdocs
  GROUP BY 1, 2), j AS (SELECT a.*, b.docs, row_number() OVER (PARTITION BY a.master ORDER BY articles DESC, a.mention_date) AS r
  FROM a JOIN b ON a.master = b.master AND a.mention_date = b.mention_date)
SELECT master AS id, count(*) AS mention_days, min(mention_date) AS first_day, max(mention_date) AS last_day, CAST(sum(docs) AS BIGINT) AS total_docs, CAST(sum(articles) AS BIGINT) AS reference_counts, max(mention_date) FILTER (WHERE r = 1) AS peak_day, max(articles) FILTER (WHERE r = 1) AS peak_articles
FROM j GROUP BY 1""", "fdocs", "dem")(
    lambda m: E.merge_canonical_events(m.ce, m.event_docs))
query("refresh_event_stats", """SELECT id, total_articles AS articles, total_mention_days AS days, first_mention_date AS first_day, last_mention_date AS last_day
FROM ce WHERE id % 3 = 0""", "ce")(
    lambda m: E.refresh_event_stats(m.ce.withColumn("total_articles", F.col("total_articles") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)), m.event_docs))
query("split_candidates", """SELECT id, CAST(last_mention_date - first_mention_date AS BIGINT) AS span_days, total_articles
FROM ce WHERE last_mention_date - first_mention_date > 20 ORDER BY total_articles DESC, id LIMIT 10""", "ce")(
    lambda m: E.split_candidates(m.ce, 20, 10))
query("event_days_gap", """SELECT canonical_event_id, mention_date, CAST(mention_date - lag(mention_date) OVER (PARTITION BY canonical_event_id
    ORDER BY mention_date) AS BIGINT) AS gap FROM dem""", "dem")(
    lambda m: E.days_gap(m.dem))
query("daily_event_summary", "SELECT * FROM es", "es")(lambda m: m.es)
query("event_source_links", """SELECT l.es_id, l.doc_id, CASE WHEN row_number() OVER (PARTITION BY l.es_id
  ORDER BY d.date DESC, l.doc_id) <= 5 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS contribution_weight
FROM links l JOIN d ON d.doc_id = l.doc_id""", "links", "d")(
    lambda m: E.event_source_links(m.links, m.d))
query("event_source_documents", """w AS (SELECT l.es_id, l.doc_id, d.date, row_number() OVER (PARTITION BY l.es_id ORDER BY d.date DESC, l.doc_id) AS r
  FROM links l JOIN d ON d.doc_id = l.doc_id) SELECT es_id, doc_id, date, CAST(r AS INT) AS rank
FROM w WHERE r <= 3""", "links", "d")(
    lambda m: N.top_n_per_group(m.links.join(m.d.select("doc_id", "date"), "doc_id"), ["es_id"], [F.desc("date"), F.asc("doc_id")], 3))
RNG = """r AS (SELECT greatest(p, DATE '2024-01-03') AS period_start, least(p + 6, DATE '2024-01-30') AS period_end
  FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 7 DAY)) AS DATE) AS p))"""
query("rollup_period", RNG + """, i AS (SELECT es.*, r.period_start AS ps, r.period_end AS pe
  FROM es JOIN r ON es.period_start >= r.period_start AND es.period_end <= r.period_end),
n AS (SELECT initiating_country, event_name, ps, count(DISTINCT doc_id) AS n_docs
  FROM i JOIN links l ON l.es_id = i.es_id GROUP BY 1, 2, 3), g AS (SELECT initiating_country, event_name, ps, pe, min(period_start) AS first_observed, max(period_end) AS last_observed, count(*) AS n_parts
  FROM i GROUP BY 1, 2, 3, 4) SELECT g.initiating_country, g.event_name, g.ps AS period_start, g.pe AS period_end, first_observed, last_observed, n_parts, n_docs
FROM g LEFT JOIN n ON n.initiating_country = g.initiating_country AND n.event_name = g.event_name AND n.ps = g.ps""", "links")(
    lambda m: E.rollup_period(m.es, m.links, E.period_ranges(m.spark, "2024-01-03", "2024-01-30", "week"), "week")
)
LAT = """k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(canonical_event_id AS VARCHAR), concat(lower(trim(event_name)), '|', initiating_country))
    ORDER BY period_start DESC, es_id) AS r FROM es)"""
query("latest_per_key", LAT + " SELECT es_id, event_name, period_start FROM k WHERE r = 1", "es")(lambda m: E.latest_per_key(m.es).select("es_id", "event_name", "period_start"))
query("asof_latest_narrative", """SELECT event_name, initiating_country, es_id, period_start FROM (SELECT *, row_number() OVER (PARTITION BY event_name, initiating_country
    ORDER BY period_start DESC, es_id DESC) AS r FROM es) WHERE r = 1""", "es")(
    lambda m: E.asof_latest_narrative(m.es))
query("resolve_missing_event_link", """f AS (SELECT canonical_name, initiating_country, min(id) AS f
  FROM ce WHERE master_event_id IS NULL GROUP BY 1, 2) SELECT es_id, coalesce(canonical_event_id, f) AS canonical_event_id
FROM es LEFT JOIN f ON f.canonical_name = es.event_name AND f.initiating_country = es.initiating_country""", "es")(
    lambda m: E.resolve_missing_event_link(m.es, m.ce))
query("cross_period_view", """SELECT DISTINCT es_id FROM es WHERE canonical_event_id = 5 OR (canonical_event_id IS NULL AND event_name = (SELECT canonical_name
    FROM ce WHERE id = 20) AND initiating_country = (SELECT initiating_country FROM ce WHERE id = 20))""", "es")(
    lambda m: m.es.where("canonical_event_id = 5")
    .select("es_id")
    .unionByName(m.es.where("canonical_event_id IS NULL").join(m.ce.where("id = 20").select(F.col("canonical_name").alias("event_name"), "initiating_country"), ["event_name", "initiating_country"], "left_semi").select("es_id"))
    .dropDuplicates(["es_id"])
)
query("summary_statistics", """SELECT count(*) AS n, count(DISTINCT event_name) AS n_names, count(DISTINCT initiating_country) AS n_countries, CAST(sum(total_documents) AS BIGINT) AS n_docs, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean_score, min(period_start) AS first_day, max(period_end) AS last_day
FROM es""", "es")(
    lambda m: E.summary_statistics(m.es))
query("period_stats", "SELECT initiating_country, period_type, count(*) AS n, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean FROM es GROUP BY 1, 2", "es")(
    lambda m: m.es.groupBy("initiating_country", "period_type")
    .agg(F.count("*").alias("n"), F.round(F.avg(F.col("material_score").cast("double")), 6).alias("mean")))
query("top_events_by_period", """SELECT event_name, count(DISTINCT period_start) AS n_days, CAST(sum(total_documents) AS BIGINT) AS n_docs, min(period_start) AS first_day, max(period_start) AS last_day
FROM es WHERE period_start BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""", "es")(
    lambda m: E.top_events_by_period(m.es, "2024-01-05", "2024-01-20", 10))
query("weekly_top_events", "SELECT event_name, count(DISTINCT date_trunc('week', period_start)) AS n_weeks FROM es GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "es")(
    lambda m: E.top_k(m.es.groupBy("event_name").agg(F.count_distinct(F.trunc("period_start", "week")).alias("n_weeks")), [F.desc("n_weeks"), F.asc("event_name")], 10))
query("event_comparison", """SELECT event_name, count(DISTINCT initiating_country) AS n_countries, max(period_start) AS latest, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean
FROM es GROUP BY 1 HAVING count(DISTINCT initiating_country) >= 2""", "es")(
    lambda m: m.es.groupBy("event_name")
    .agg(F.count_distinct("initiating_country").alias("n_countries"), F.max("period_start").alias("latest"), F.round(F.avg(F.col("material_score").cast("double")), 6).alias("mean"))
    .where("n_countries >= 2"))
query("page", "SELECT doc_id, date FROM d ORDER BY date DESC, doc_id LIMIT 25 OFFSET 50", "d")(
    lambda m: E.page(m.d.select("doc_id", "date"), [F.desc("date"), F.asc("doc_id")], 3, 25))
query("top_k", "SELECT doc_id, date FROM d ORDER BY date DESC, doc_id LIMIT 25", "d")(lambda m: E.top_k(m.d.select("doc_id", "date"), [F.desc("date"), F.asc("doc_id")], 25))
query("nulls_last_order", "SELECT id, material_score FROM ce ORDER BY material_score DESC NULLS LAST, id LIMIT 400", "ce")(
    lambda m: E.top_k(m.ce.select("id", "material_score"), [F.desc_nulls_last("material_score"), F.asc("id")], 400))
query("pair_events_by_materiality", """SELECT es_id, material_score FROM es WHERE initiating_country = 'NATION_1' AND material_score >= 5
ORDER BY material_score DESC, period_start DESC, es_id LIMIT 10""", "es")(
    lambda m: E.top_k(m.es.where("initiating_country = 'NATION_1' AND material_score >= 5"), [F.desc("material_score"), F.desc("period_start"), F.asc("es_id")], 10)
    .select("es_id", "material_score"))
query("assign_best_category", """a AS (SELECT canonical_event_id, count(DISTINCT doc_id) AS all_docs
  FROM dem_docs GROUP BY 1), g AS (SELECT x.canonical_event_id, cat.category, count(DISTINCT x.doc_id) AS n_docs
  FROM dem_docs x JOIN cat ON cat.doc_id = x.doc_id GROUP BY 1, 2),
j AS (SELECT g.*, a.all_docs, row_number() OVER (PARTITION BY g.canonical_event_id ORDER BY n_docs DESC, category) AS r
  FROM g JOIN a ON a.canonical_event_id = g.canonical_event_id WHERE n_docs >= greatest(2, ceil(all_docs * 0.25)))
SELECT canonical_event_id, category, n_docs, all_docs FROM j WHERE r = 1""", "dem_docs", "cat")(
    lambda m: E.assign_best_category(m.event_docs, m.cat))
query("pair_event_stats", """SELECT ce.initiating_country, r.key AS recipient, count(*) AS n, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean
FROM ce JOIN rcounts r ON r.id = ce.id WHERE master_event_id IS NULL
GROUP BY 1, 2""", "ce", "rcounts")(
    lambda m: E.masters(m.ce_maps)
    .select("initiating_country", "material_score", F.explode(F.map_keys("primary_recipients")).alias("recipient"))
    .groupBy("initiating_country", "recipient")
    .agg(F.count("*").alias("n"), F.round(F.avg(F.col("material_score").cast("double")), 6).alias("mean")))
query("country_grouping", """SELECT coalesce(r.key, 'Unknown') AS recipient, count(*) AS n, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean
FROM ce LEFT JOIN rcounts r ON r.id = ce.id GROUP BY 1""", "ce", "rcounts")(
    lambda m: m.ce_maps.select("material_score", F.explode_outer(F.map_keys("primary_recipients")).alias("k"))
    .groupBy(F.coalesce("k", F.lit("Unknown")).alias("recipient"))
    .agg(F.count("*").alias("n"), F.round(F.avg(F.col("material_score").cast("double")), 6).alias("mean")))
query("event_materiality_buckets", """SELECT count(*) FILTER (WHERE material_score < 4) AS low, count(*) FILTER (WHERE material_score >= 4 AND material_score < 7) AS med, count(*) FILTER (WHERE material_score >= 7) AS high, count(*) FILTER (WHERE material_score IS NULL) AS unscored
FROM ce""", "ce")(
    lambda m: m.ce.agg(F.count_if(F.col("material_score") < 4).alias("low"), F.count_if((F.col("material_score") >= 4) & (F.col("material_score") < 7)).alias("med"), F.count_if(F.col("material_score") >= 7).alias("high"), F.count_if(F.col("material_score").isNull()).alias("unscored")))
query("pair_events", """SELECT DISTINCT f.master AS id FROM fdocs f WHERE f.doc_id IN (SELECT ic.doc_id
  FROM ic JOIN rc ON rc.doc_id = ic.doc_id WHERE initiating_country = 'NATION_1' AND recipient_country = 'NATION_2')""", "fdocs", "ic", "rc")(
    lambda m: E.family_docs(m.ce, m.event_docs)
    .join(m.ic.where("initiating_country = 'NATION_1'").join(m.rc.where("recipient_country = 'NATION_2'"), "doc_id").select("doc_id"), "doc_id", "left_semi")
    .select(F.col("master").alias("id"))
    .distinct())
query("docs_for_clustering", """SELECT DISTINCT ic.initiating_country, d.date, r.doc_id, r.event_name
FROM raw_events r JOIN d ON d.doc_id = r.doc_id JOIN ic ON ic.doc_id = r.doc_id
WHERE ic.initiating_country IN {INF} AND EXISTS (SELECT 1 FROM rc
  WHERE rc.doc_id = r.doc_id AND rc.recipient_country IN {REC}) AND NOT EXISTS (SELECT 1
  FROM rc WHERE rc.doc_id = r.doc_id AND rc.recipient_country = ic.initiating_country)""", "raw_events", "d", "rc")(
    lambda m: m._raw_events().select("doc_id", "event_name").join(m.d.select("doc_id", "date"), "doc_id")
    .join(m.ic.where(F.col("initiating_country").isin(*m.scope.influencers)), "doc_id")
    .join(m.rc.where(F.col("recipient_country").isin(*m.scope.recipients)).select("doc_id"), "doc_id", "left_semi")
    .join(m.rc.withColumnRenamed("recipient_country", "initiating_country"), ["doc_id", "initiating_country"], "left_anti")
    .select("initiating_country", "date", "doc_id", "event_name")
    .distinct()
)
query("coverage_gap_dates", """c AS (SELECT DISTINCT country, day FROM vectors) SELECT country, day
FROM c WHERE NOT EXISTS (SELECT 1 FROM dem x JOIN ce ON ce.id = x.canonical_event_id
  WHERE ce.initiating_country = c.country AND x.mention_date = c.day)""", "vectors", "ce")(
    lambda m: m.vectors.select("country", "day")
    .distinct()
    .join(m.dem.join(m.ce.select(F.col("id").alias("canonical_event_id"), F.col("initiating_country").alias("country")), "canonical_event_id").select("country", F.col("mention_date").alias("day")), ["country", "day"], "left_anti"))
