"""Queries of event construction, themes and the remaining lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import construct as K
from ..operators import counts as N
from ..operators import events as E
from ..operators import facts as P
from ..operators import graph as G
from .model import Model
from .queries_counts import base, intensity
from .queries_events import RNG
from .registry import query


def clusters(m: Model):
    return m.raw_events.groupBy((F.col("doc_id") % 50).alias("cluster")).agg(F.collect_list(F.struct(F.col("event_name").alias("name"), "doc_id")).alias("members"))


query("needs_review", "SELECT doc_id % 50 AS cluster FROM raw_events GROUP BY 1 HAVING count(DISTINCT event_name) > 1", "raw_events")(
    lambda m: K.needs_review(clusters(m))
    .select("cluster"))
_N = """m AS (SELECT doc_id % 50 AS cluster, event_name AS name, doc_id
  FROM raw_events), nm AS (SELECT cluster, name, row_number() OVER (PARTITION BY cluster ORDER BY name) AS idx
  FROM (SELECT DISTINCT cluster, name FROM m)), g AS (SELECT m.cluster, CASE WHEN m.cluster % 2 = 0 THEN CAST(nm.idx % 3 AS INT) ELSE 0 END AS \"group\", m.name, m.doc_id
  FROM m JOIN nm ON nm.cluster = m.cluster AND nm.name = m.name),
c AS (SELECT cluster, \"group\", name, count(*) AS n FROM g GROUP BY 1, 2, 3),
l AS (SELECT cluster, \"group\", name AS event_name FROM (SELECT *, row_number() OVER (PARTITION BY cluster, \"group\"
    ORDER BY n DESC, name) AS r FROM c) WHERE r = 1)"""


def decisions(m: Model):
    n = clusters(m).where("cluster % 2 = 0").select("cluster", F.size(F.array_distinct(F.transform("members", lambda x: x["name"]))).alias("n"))
    return n.select("cluster", F.explode(F.sequence(F.lit(1), F.col("n") + 2)).alias("idx")).select("cluster", (F.col("idx") % 3).alias("group"), "idx")


query("apply_group_decisions", _N + """ SELECT g.cluster, g.\"group\", count(DISTINCT doc_id) AS n_docs, any_value(l.event_name) AS event_name
FROM g JOIN l ON l.cluster = g.cluster AND l.\"group\" = g.\"group\"
GROUP BY 1, 2""", "raw_events")(
    lambda m: K.apply_group_decisions(clusters(m), decisions(m)))
query("keep_proposition", """r AS (SELECT doc_id, list(recipient_country) AS rs FROM rc GROUP BY 1)
SELECT ic.doc_id, CASE WHEN r.rs IS NULL THEN 'no recipient' WHEN len(list_filter(r.rs, lambda x: x <> ic.initiating_country)) = 0 THEN 'self-country' WHEN d.medium = 'O' AND NOT d.title LIKE '%1-URGENT%' THEN 'private individual' END AS reason
FROM ic JOIN d ON d.doc_id = ic.doc_id LEFT JOIN r ON r.doc_id = ic.doc_id""", "d", "rc")(
    lambda m: K.keep_proposition(m.ic.join(m.d.select("doc_id", "medium", "title"), "doc_id").join(m.rc.groupBy("doc_id").agg(F.collect_set("recipient_country").alias("rs")), "doc_id", "left").select("doc_id", F.col("initiating_country").alias("initiator"), F.coalesce("rs", F.array().cast("array<string>")).alias("recipients"), F.col("title").alias("text"), (F.col("medium") == "O").alias("private")), "1-URGENT")
    .select("doc_id", "reason")
)
query("narrative_themes", None)(lambda m: K.narrative_themes(m.vectors))
query("recipient_blocs", None)(
    lambda m: K.recipient_blocs(P.recipient_profiles(intensity(m)).select("recipient_country", F.concat_ws(":", "initiating_country", "category").alias("lane"), F.coalesce("share", F.lit(0.0)).alias("share"))))
query("entity_curation_candidates", """t AS (SELECT id FROM ce WHERE master_event_id IS NULL ORDER BY total_articles DESC, id LIMIT 5),
x AS (SELECT DISTINCT den.entity, f.master, f.doc_id FROM fdocs f
  JOIN t ON t.id = f.master JOIN den ON den.doc_id = f.doc_id) SELECT entity, count(DISTINCT master) AS n_events, count(DISTINCT doc_id) AS n_docs
FROM x GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""", "fdocs", "den")(
    lambda m: E.top_k(E.family_docs(m.ce, m.event_docs).join(E.top_k(E.masters(m.ce), [F.desc("total_articles"), F.asc("id")], 5).select(F.col("id").alias("master")), "master", "left_semi").join(m.den.select("entity", "doc_id").distinct(), "doc_id").groupBy("entity").agg(F.count_distinct("master").alias("n_events"), F.count_distinct("doc_id").alias("n_docs")), [F.desc("n_docs"), F.asc("entity")], 20)
)
query("entities_for_events", """SELECT f.master, den.entity, count(DISTINCT f.doc_id) AS n_docs
FROM fdocs f JOIN den ON den.doc_id = f.doc_id WHERE f.master IN (0, 5, 10)
GROUP BY 1, 2""", "fdocs", "den")(
    lambda m: E.family_docs(m.ce, m.event_docs)
    .where("master IN (0, 5, 10)")
    .join(m.den.select("entity", "doc_id").distinct(), "doc_id")
    .groupBy("master", "entity")
    .agg(F.count_distinct("doc_id").alias("n_docs")))


def weekly(m: Model):
    w = E.rollup_period(m.es, m.links, E.period_ranges(m.spark, "2024-01-03", "2024-01-30", "week"), "week")
    return w.withColumn("es_id", F.concat(F.lit("W"), "initiating_country", F.lit("|"), "event_name", F.lit("|"), F.col("period_start").cast("string")))


query("backfill_links", RNG + """, i AS (SELECT es.*, r.period_start AS ps FROM es JOIN r ON es.period_start >= r.period_start AND es.period_end <= r.period_end)
SELECT DISTINCT concat('W', i.initiating_country, '|', i.event_name, '|', CAST(i.ps AS VARCHAR)) AS es_id, l.doc_id
FROM i JOIN links l ON l.es_id = i.es_id WHERE i.initiating_country <> 'NATION_1'""", "links")(
    lambda m: E.backfill_links(weekly(m), weekly(m).where("initiating_country = 'NATION_1'"), m.es, m.links)
)
query("event_stats", """SELECT count(*) AS n, CAST(sum(total_articles) AS BIGINT) AS articles, count(material_score) AS scored
FROM ce WHERE first_mention_date <= DATE '2024-01-20' AND last_mention_date >= DATE '2024-01-10'""", "ce")(
    lambda m: m.ce.where("first_mention_date <= DATE'2024-01-20' AND last_mention_date >= DATE'2024-01-10'")
    .agg(F.count("*").alias("n"), F.sum("total_articles").alias("articles"), F.count("material_score").alias("scored")))
