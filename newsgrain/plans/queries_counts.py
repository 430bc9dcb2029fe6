"""Queries of scopes, counts and provenance facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import counts as N
from ..operators import facts as P
from .model import Model
from .registry import query

SP = """sp AS (SELECT d.*, ic.initiating_country, rc.recipient_country
  FROM d JOIN ic ON ic.doc_id = d.doc_id JOIN rc ON rc.doc_id = d.doc_id
  WHERE ic.initiating_country IN {INF} AND rc.recipient_country IN {REC} AND ic.initiating_country <> rc.recipient_country AND d.date >= DATE '1996-01-01' AND d.date < DATE '2001-01-01')"""
BASE = ("d", "ic", "rc")


def pairs(m: Model):
    return N.scope_pairs(m.d, m.ic, m.rc, m.scope)


def base(m: Model):
    return P.report_base(m.d, m.ic, m.rc, m.cat, m.scope)


def intensity(m: Model):
    """Provenance intensity, kept by month."""
    return m.facts.by_month("provenance-intensity", m.inputs("orders", "customer", "nation", "lineitem", "supplier", "part"), lambda: base(m), P.provenance_intensity)


query("report_base", "SELECT * FROM rb", "rb")(base)
query("scope_docs", """SELECT DISTINCT d.doc_id FROM d JOIN ic ON ic.doc_id = d.doc_id
JOIN rc ON rc.doc_id = d.doc_id WHERE initiating_country IN {INF} AND recipient_country IN {REC} AND initiating_country <> recipient_country AND date >= DATE '1996-01-01'""", *BASE)(
    lambda m: N.scope_docs(m.d, m.ic, m.rc, m.scope))
query("apply_filters", SP + """ SELECT doc_id, date, initiating_country, recipient_country FROM sp
WHERE initiating_country IN ('NATION_1', 'NATION_2') AND recipient_country IN ('NATION_5') AND date <= DATE '1998-06-30'""", *BASE)(
    lambda m: N.apply_filters(pairs(m), countries=["NATION_1", "NATION_2"], recipients=["NATION_5"], end="1998-06-30", scope=m.scope)
    .select("doc_id", "date", "initiating_country", "recipient_country")
)
query("doc_scope", """SELECT doc_id, date FROM d WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND doc_id IN (SELECT doc_id
  FROM ic WHERE initiating_country = 'NATION_1') AND doc_id IN (SELECT doc_id
  FROM rc WHERE recipient_country IN ('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4')) AND doc_id IN (SELECT doc_id
  FROM cat WHERE category = 'ECONOMY')""", "d", "rc", "cat")(
    lambda m: N.doc_scope(m.d, m.ic, m.rc, m.cat, m.sub, influencer="NATION_1", recipients=m.scope.groups["first five"], category="ECONOMY", start="1997-01-01", end="1998-12-31")
    .select("doc_id", "date")
)
query("docs_per_week", SP + """ SELECT CAST(date_trunc('week', sp.date) AS DATE) AS week, count(DISTINCT sp.doc_id) AS n_docs
FROM sp JOIN cat ON cat.doc_id = sp.doc_id WHERE category IN {CAT}
GROUP BY 1""", *BASE, "cat")(
    lambda m: N.docs_per_period(base(m), "week"))
query("docs_per_month", "SELECT * FROM (" + "SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT doc_id) AS n_docs FROM rb GROUP BY 1 ORDER BY 1 DESC LIMIT 12)", "rb")(
    lambda m: N.docs_per_period(base(m), "month", last=12))
query("docs_per_month_by", SP + """ SELECT CAST(date_trunc('month', date) AS DATE) AS month, initiating_country, recipient_country, count(DISTINCT doc_id) AS n_docs
FROM sp GROUP BY ALL""", *BASE)(
    lambda m: N.docs_per_period(pairs(m), "month", ["initiating_country", "recipient_country"]))
query("docs_per_day", SP + " SELECT date AS day, count(DISTINCT doc_id) AS n_docs FROM sp GROUP BY ALL", *BASE)(lambda m: N.docs_per_period(pairs(m), "day"))
query("docs_by_dim", "SELECT coalesce(source_geofocus, 'Unknown') AS source_geofocus, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "d")(
    lambda m: N.count_docs(m.d, ["source_geofocus"], k=10, unknown="Unknown"))
query("docs_by_two_dims", "SELECT initiating_country, category, count(DISTINCT doc_id) AS n_docs FROM rb GROUP BY ALL", "rb")(
    lambda m: N.count_docs(base(m), ["initiating_country", "category"]))
query("week_recipient_influencer_cube", SP + " SELECT CAST(date_trunc('week', date) AS DATE) AS week, recipient_country, initiating_country, count(DISTINCT doc_id) AS n_docs FROM sp GROUP BY ALL", *BASE)(
    lambda m: N.cube_by_week(pairs(m))
    .select("week", F.explode("counts").alias("k", "n_docs"))
    .select("week", F.split_part("k", F.lit("|"), F.lit(1)).alias("recipient_country"), F.split_part("k", F.lit("|"), F.lit(2)).alias("initiating_country"), "n_docs")
)
query("overview_metrics", SP + """, t AS (SELECT count(DISTINCT doc_id) AS total_docs, count(DISTINCT doc_id) FILTER (WHERE NOT coalesce(source_geofocus ILIKE concat('%', initiating_country, '%'), false)) AS corroborated_docs, count(DISTINCT (initiating_country, recipient_country)) AS active_pairs, count(DISTINCT recipient_country) AS active_recipients
  FROM sp) SELECT *, round(1 - corroborated_docs / nullif(CAST(total_docs AS DOUBLE), 0), 3) AS self_share
FROM t""", *BASE)(
    lambda m: N.overview_metrics(pairs(m)))
query("provenance_intensity", "SELECT *, round(CAST(self_docs AS DOUBLE) / nullif(raw_docs, 0), 3) AS self_share, third_docs AS normalized FROM pi", "pi")(
    lambda m: intensity(m))
query("actor_tensor", """SELECT initiating_country, category, month, CAST(sum(raw_docs) AS BIGINT) AS raw_docs, CAST(sum(self_docs) AS BIGINT) AS self_docs, CAST(sum(third_docs) AS BIGINT) AS third_docs, CAST(sum(distinct_sources) AS BIGINT) AS distinct_sources
FROM pi GROUP BY 1,2,3""", "pi")(
    lambda m: P.actor_tensor(intensity(m)))
query("provenance_stats", """SELECT category, count(DISTINCT doc_id) AS raw_docs, count(DISTINCT doc_id) FILTER (WHERE coalesce(self_reported, false)) AS self_docs, count(DISTINCT doc_id) FILTER (WHERE NOT coalesce(self_reported, false)) AS third_docs
FROM rb WHERE initiating_country = 'NATION_1' GROUP BY 1""", "rb")(
    lambda m: P.provenance_stats(base(m), "NATION_1"))
query("source_provenance_map", "SELECT source_name, count(*) AS n_docs, mode() WITHIN GROUP (ORDER BY source_geofocus) AS dominant_geofocus FROM d GROUP BY 1", "d")(
    lambda m: P.source_provenance_map(m.d))
query("rollup_report", """SELECT initiating_country, recipient_country, category, count(DISTINCT doc_id) AS n_docs, CAST(grouping(initiating_country, recipient_country, category) AS BIGINT) AS level
FROM rb GROUP BY CUBE (initiating_country, recipient_country, category)""", "rb")(
    lambda m: N.rollup_cube(base(m)))
query("shared_recipients", SP + """ SELECT recipient_country, count(DISTINCT initiating_country) AS n_actors, count(DISTINCT doc_id) AS n_docs
FROM sp GROUP BY 1 HAVING count(DISTINCT initiating_country) >= 2""", *BASE)(
    lambda m: N.shared_recipients(pairs(m)))
query("source_diversity", """SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT source_name) AS distinct_sources, count(DISTINCT doc_id) AS n_docs
FROM d GROUP BY 1""", "d")(
    lambda m: N.source_diversity(m.d))
query("search_documents", """p AS (SELECT doc_id, date, title FROM d WHERE (title ILIKE '%doc 12%' OR distilled_text ILIKE '%doc 12%')
  ORDER BY date DESC, doc_id LIMIT 20) SELECT p.*, (SELECT string_agg(category, '; ' ORDER BY category)
  FROM cat WHERE cat.doc_id = p.doc_id) AS categories FROM p""", "d", "cat")(
    lambda m: N.search_documents(m.d, m.cat, m.ic, term="doc 12"))
query("document_details", """x AS (SELECT doc_id, date, title FROM d WHERE medium = 'P'), a AS (SELECT doc_id, string_agg(category, '; '
    ORDER BY category) AS categories FROM cat GROUP BY 1), b AS (SELECT doc_id, string_agg(recipient_country, '; '
    ORDER BY recipient_country) AS recipients FROM rc GROUP BY 1)
SELECT x.*, categories, recipients FROM x LEFT JOIN a ON a.doc_id = x.doc_id
LEFT JOIN b ON b.doc_id = x.doc_id""", "d", "cat", "rc")(
    lambda m: N.document_details(m.d.where("medium = 'P'"), m.cat, m.rc)
)
query("share_of_total", """g AS (SELECT category, count(DISTINCT doc_id) AS n_docs FROM rb
  GROUP BY 1) SELECT *, round(100.0::DOUBLE * n_docs / sum(n_docs) OVER (), 2) AS share
FROM g""", "rb")(
    lambda m: N.share_of_total(N.count_docs(base(m), ["category"]), "n_docs"))
query("share_within_group", """g AS (SELECT initiating_country, category, count(DISTINCT doc_id) AS n_docs
  FROM rb GROUP BY 1, 2) SELECT *, round(100.0::DOUBLE * n_docs / sum(n_docs) OVER (PARTITION BY initiating_country), 2) AS share
FROM g""", "rb")(
    lambda m: N.share_of_total(N.count_docs(base(m), ["initiating_country", "category"]), "n_docs", within=["initiating_country"]))
query("top_n_per_group", """g AS (SELECT initiating_country, source_name, count(DISTINCT doc_id) AS n_docs
  FROM rb GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY initiating_country
    ORDER BY n_docs DESC, source_name) AS INT) AS rank FROM g) WHERE rank <= 2""", "rb")(
    lambda m: N.top_n_per_group(N.count_docs(base(m), ["initiating_country", "source_name"]), ["initiating_country"], [F.desc("n_docs"), F.asc("source_name")], 2))
query("leader_per_group", """g AS (SELECT recipient_country, initiating_country, count(DISTINCT doc_id) AS n
  FROM rb GROUP BY 1, 2) SELECT recipient_country, initiating_country AS leader, n AS leader_docs
FROM (SELECT *, row_number() OVER (PARTITION BY recipient_country ORDER BY n DESC, initiating_country) AS r
  FROM g) WHERE r = 1""", "rb")(
    lambda m: N.leader_per_group(N.count_docs(base(m), ["recipient_country", "initiating_country"]), ["recipient_country"], "initiating_country", "n_docs"))
query("lane_leaders", """g AS (SELECT category, initiating_country, count(DISTINCT doc_id) AS n
  FROM rb WHERE recipient_country = 'NATION_7' GROUP BY 1, 2) SELECT category, initiating_country AS leader, n AS leader_docs
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, initiating_country) AS r
  FROM g) WHERE r = 1""", "rb")(
    lambda m: N.leader_per_group(N.count_docs(base(m).where("recipient_country = 'NATION_7'"), ["category", "initiating_country"]), ["category"], "initiating_country", "n_docs"))
PRB = """pb AS (SELECT d.doc_id, d.date, CAST(date_trunc('month', d.date) AS DATE) AS month, rc.recipient_country, cat.category, d.source_name, d.source_geofocus, CASE WHEN d.source_geofocus ILIKE '%NATION_24%' THEN 'adversary' WHEN d.source_geofocus ILIKE '%NATION_7%' OR d.source_geofocus ILIKE '%NATION_8%' THEN 'partner' ELSE 'neutral/other' END AS framing
  FROM d JOIN ic ON ic.doc_id = d.doc_id JOIN rc ON rc.doc_id = d.doc_id
  JOIN cat ON cat.doc_id = d.doc_id WHERE ic.initiating_country = 'NATION_7' AND rc.recipient_country IN {REC} AND cat.category IN {CAT} AND ic.initiating_country <> rc.recipient_country AND d.date >= DATE '1996-01-01' AND d.date < DATE '2001-01-01')"""


def partner(m: Model, *facts: DataFrame):
    """Asks for one country only, and so takes no facts of all documents, unless a query has them anyway."""
    return P.partner_report_base(*(facts or m.of_initiator("NATION_7", m.scope)), m.scope, "NATION_7", ["NATION_24"], ["NATION_7", "NATION_8"])


def both(m: Model):
    return partner(m, m.d, m.ic, m.rc, m.cat)


query("partner_report_base", PRB + " SELECT * FROM pb", "d", "rc", "cat")(partner)
query("framing_share", PRB + """, g AS (SELECT recipient_country, framing, count(DISTINCT doc_id) AS n_docs
  FROM pb GROUP BY 1, 2), t AS (SELECT *, CAST(sum(n_docs) OVER (PARTITION BY recipient_country) AS BIGINT) AS total
  FROM g) SELECT * FROM t WHERE total > 3""", "d", "rc", "cat")(
    lambda m: P.framing_share(partner(m), 3))
query("tug_of_war", PRB + """, p AS (SELECT recipient_country, count(DISTINCT doc_id) AS partner_docs
  FROM pb GROUP BY 1), r AS (SELECT recipient_country, max(n) AS rival_docs
  FROM (SELECT recipient_country, initiating_country, count(DISTINCT doc_id) AS n FROM rb GROUP BY 1, 2)
  GROUP BY 1) SELECT p.recipient_country, partner_docs, rival_docs
FROM p JOIN r ON p.recipient_country = r.recipient_country WHERE greatest(partner_docs, rival_docs) > 10""", "rb")(
    lambda m: P.tug_of_war(both(m), base(m), 10))
query("signature_vs_peers", """g AS (SELECT initiating_country, category, count(DISTINCT doc_id) AS n
  FROM rb GROUP BY 1, 2), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY initiating_country) AS DOUBLE) AS share
  FROM g) SELECT initiating_country, category, round(share, 6) AS share, round(share - avg(share) OVER (PARTITION BY category), 6) AS vs_peers
FROM s""", "rb")(
    lambda m: P.signature_vs_peers(base(m)))
query("union_actors", PRB + """ SELECT 'NATION_7' AS initiating_country, recipient_country, category, count(DISTINCT doc_id) AS n_docs
FROM pb GROUP BY ALL UNION ALL SELECT initiating_country, recipient_country, category, count(DISTINCT doc_id)
FROM rb GROUP BY ALL""", "rb")(
    lambda m: N.count_docs(base(m).select("doc_id", "initiating_country", "recipient_country", "category").unionByName(both(m).select("doc_id", F.lit("NATION_7").alias("initiating_country"), "recipient_country", "category"), allowMissingColumns=True), ["initiating_country", "recipient_country", "category"])
)
LED = """e AS (SELECT * FROM ce WHERE initiating_country IN {INF}),
r AS (SELECT x.id, string_agg(DISTINCT x.c, ',' ORDER BY x.c) AS recipients, CAST(sum(x.n) AS BIGINT) AS recipient_mentions FROM (SELECT id, n, CASE WHEN key = 'NATION_18' THEN 'NATION_17' ELSE key END AS c FROM rcounts WHERE key IN {REC}) x JOIN e ON e.id = x.id WHERE x.c <> e.initiating_country GROUP BY 1),
dd AS (SELECT DISTINCT x.canonical_event_id AS id, x.doc_id, d.source_name, coalesce(d.source_geofocus ILIKE concat('%', e.initiating_country, '%'), false) AS own FROM dem_docs x JOIN d ON d.doc_id = x.doc_id JOIN e ON e.id = x.canonical_event_id),
p AS (SELECT id, count(*) AS linked_docs, count(*) FILTER (WHERE own) AS self_docs, count(*) FILTER (WHERE NOT own) AS third_docs, count(DISTINCT source_name) AS distinct_sources FROM dd GROUP BY 1),
led AS (SELECT e.id, e.initiating_country, e.canonical_name, e.first_mention_date, e.last_mention_date, e.total_articles, e.material_score, r.recipients, r.recipient_mentions, coalesce(linked_docs, 0) AS linked_docs, coalesce(self_docs, 0) AS self_docs, coalesce(third_docs, 0) AS third_docs, coalesce(distinct_sources, 0) AS distinct_sources, round(CAST(third_docs AS DOUBLE) / nullif(linked_docs, 0), 3) AS corroboration FROM e JOIN r ON r.id = e.id LEFT JOIN p ON p.id = e.id)"""


def ledger(m: Model):
    return P.initiative_ledger(m.ce, m.event_docs, m.recipient_counts, m.d, m.scope)


LU = ("ce", "rcounts", "d")
query("initiative_ledger", LED + " SELECT * FROM led", *LU)(ledger)
query("initiative_gate", LED + """ SELECT initiating_country, count(*) AS total, count(*) FILTER (WHERE corroboration >= 0.5 AND distinct_sources >= 3) AS corroborated, count(*) FILTER (WHERE corroboration >= 0.5 AND distinct_sources >= 3 AND material_score >= 6) AS substantive
FROM led GROUP BY 1""", *LU)(
    lambda m: P.initiative_gate(ledger(m)))
query("ledger_rank", LED + """, v AS (SELECT id, canonical_name, round(coalesce(CAST(material_score AS DOUBLE), 0.0) * ln(1 + distinct_sources), 6) AS rank_value
  FROM led), o AS (SELECT *, row_number() OVER (PARTITION BY canonical_name ORDER BY rank_value DESC, id) AS r
  FROM v) SELECT id, canonical_name, rank_value FROM o WHERE r = 1
ORDER BY rank_value DESC, id LIMIT 18""", *LU)(
    lambda m: P.ledger_rank(ledger(m)))
query("canon_recipient", """SELECT doc_id, recipient_country, CASE WHEN recipient_country = 'NATION_18' THEN 'NATION_17' WHEN recipient_country IN {REC} THEN recipient_country END AS canonical, CASE WHEN recipient_country NOT IN {REC} THEN concat('unknown: ', recipient_country) END AS error
FROM rc""", "rc")(
    lambda m: P.canon_recipient(m.rc, "recipient_country", m.scope.aliases, m.scope.recipients))
CNT = "g AS (SELECT initiating_country, recipient_country, count(DISTINCT doc_id) AS n FROM rb GROUP BY 1, 2)"


def actor_counts(m: Model):
    return N.count_docs(base(m), ["initiating_country", "recipient_country"])


query("concentration_hhi", CNT + """, s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY initiating_country) AS DOUBLE) AS share
  FROM g) SELECT initiating_country, round(sum(share * share), 6) AS hhi, count(*) AS n, round(max(share), 6) AS top_share
FROM s GROUP BY 1""", "rb")(
    lambda m: P.concentration_hhi(actor_counts(m), "initiating_country"))
query("lorenz_curve", CNT + """ SELECT DISTINCT initiating_country, 0.0::DOUBLE AS p, 0.0::DOUBLE AS v
FROM g UNION ALL SELECT initiating_country, round(row_number() OVER w / CAST(count(*) OVER (PARTITION BY initiating_country) AS DOUBLE), 6), round(sum(n) OVER (PARTITION BY initiating_country
    ORDER BY n, recipient_country ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(n) OVER (PARTITION BY initiating_country) AS DOUBLE), 6)
FROM g WINDOW w AS (PARTITION BY initiating_country ORDER BY n, recipient_country)""", "rb")(
    lambda m: P.lorenz_curve(actor_counts(m), "initiating_country", "recipient_country"))
query("hedging_class", CNT + """, o AS (SELECT *, row_number() OVER (PARTITION BY recipient_country ORDER BY n DESC, initiating_country) AS r, sum(n) OVER (PARTITION BY recipient_country) AS t
  FROM g), x AS (SELECT recipient_country, max(initiating_country) FILTER (WHERE r = 1) AS leader, max(n) FILTER (WHERE r = 1) AS lead, max(n) FILTER (WHERE r = 2) AS second, CAST(max(t) AS BIGINT) AS total
  FROM o GROUP BY 1) SELECT *, CASE WHEN lead / CAST(total AS DOUBLE) >= 0.45 THEN 'single-patron' WHEN second IS NOT NULL AND lead / CAST(second AS DOUBLE) <= 1.4 THEN 'contested' ELSE 'balancing' END AS hedging
FROM x""", "rb")(
    lambda m: P.hedging_class(actor_counts(m)))
query("competitive_matrix", "t AS (SELECT DISTINCT recipient_country, initiating_country, doc_id FROM rb WHERE coalesce(self_reported, false) = false) SELECT recipient_country, " + ", ".join(f"count(*) FILTER (WHERE initiating_country = 'NATION_{i}') AS \"NATION_{i}\"" for i in range(5)) + ", count(*) AS total FROM t GROUP BY 1", "rb")(
    lambda m: P.competitive_matrix(base(m), m.scope.influencers))
query("recipient_blocs_profiles", """g AS (SELECT recipient_country, initiating_country, category, CAST(sum(third_docs) AS BIGINT) AS n
  FROM pi GROUP BY 1,2,3) SELECT *, round(n / nullif(CAST(sum(n) OVER (PARTITION BY recipient_country) AS DOUBLE), 0), 6) AS share
FROM g""", "pi")(
    lambda m: P.recipient_profiles(intensity(m)))
query("activity_series", """SELECT month, count(DISTINCT doc_id) AS raw_docs, count(DISTINCT doc_id) FILTER (WHERE NOT coalesce(self_reported, false)) AS third_docs
FROM rb WHERE initiating_country = 'NATION_2' AND category = 'SMALL'
GROUP BY 1""", "rb")(
    lambda m: base(m)
    .where("initiating_country = 'NATION_2' AND category = 'SMALL'")
    .groupBy("month")
    .agg(F.count_distinct("doc_id").alias("raw_docs"), F.count_distinct(F.when(~F.coalesce("self_reported", F.lit(False)), F.col("doc_id"))).alias("third_docs"))
)
query("self_reported_flag", "SELECT d.doc_id, d.source_geofocus ILIKE concat('%', ic.initiating_country, '%') AS self_reported FROM d JOIN ic ON ic.doc_id = d.doc_id", "d")(
    lambda m: N.self_flags(m.d.join(m.ic, "doc_id"))
    .select("doc_id", "self_reported"))
query("framing_class", """SELECT doc_id, CASE WHEN source_geofocus ILIKE '%NATION_24%' THEN 'adversary' WHEN source_geofocus ILIKE '%NATION_7%' OR source_geofocus ILIKE '%NATION_8%' THEN 'partner' ELSE 'neutral/other' END AS framing
FROM d""", "d")(
    lambda m: m.d.select("doc_id", C.framing_class(F.col("source_geofocus"), ["NATION_24"], ["NATION_7", "NATION_8"]).alias("framing")))
query("expand_group", "SELECT doc_id, recipient_country FROM rc WHERE recipient_country IN ('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4')", "rc")(
    lambda m: m.rc.where(F.col("recipient_country").isin(*m.scope.groups["first five"])))
