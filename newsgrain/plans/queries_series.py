"""Queries of time series, graphs, clustering, retrieval and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as N
from ..operators import events as E
from ..operators import facts as P
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import series as S
from ..operators.store import new_dir
from ..operators.vector_index import VectorIndex
from .model import Model
from .queries_counts import base, intensity
from .registry import query

DAY = "day AS (SELECT date AS day, initiating_country, count(DISTINCT d.doc_id) AS n_docs FROM d JOIN ic ON ic.doc_id = d.doc_id WHERE initiating_country IN {INF} GROUP BY 1, 2)"


def daily(m: Model):
    return N.docs_per_period(m.d.join(m.ic.where(F.col("initiating_country").isin(*m.scope.influencers)), "doc_id"), "day", ["initiating_country"])


K = ["initiating_country"]
query("rolling_zscore", DAY + """, w AS (SELECT *, count(*) OVER f AS c, avg(n_docs) OVER f AS m, stddev_samp(n_docs) OVER f AS s
  FROM day WINDOW f AS (PARTITION BY initiating_country ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, round(CASE WHEN c >= 7 AND s > 0 THEN (n_docs - m) / s ELSE 0.0 END, 6) AS z
  FROM w) SELECT initiating_country, day, n_docs, z, CASE WHEN c >= 7 THEN round(m, 1) END AS expected, abs(z) > 2 AS flag
FROM z""", "d")(
    lambda m: S.rolling_zscore(daily(m), K))
query("global_zscore", DAY + """ SELECT day, initiating_country, n_docs, round(CASE WHEN stddev_samp(n_docs) OVER w > 0 THEN (n_docs - avg(n_docs) OVER w) / stddev_samp(n_docs) OVER w ELSE 0.0 END, 6) AS z
FROM day WINDOW w AS (PARTITION BY initiating_country)""", "d")(
    lambda m: S.global_zscore(daily(m), K))
MON = """mon AS (SELECT initiating_country, month, CAST(sum(raw_docs) AS BIGINT) AS n
  FROM pi GROUP BY 1, 2), sp AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS month),
zf AS (SELECT i.initiating_country, sp.month, CAST(coalesce(n, 0) AS DOUBLE) AS y
  FROM (SELECT DISTINCT initiating_country FROM mon) i CROSS JOIN sp
  LEFT JOIN mon ON mon.initiating_country = i.initiating_country AND mon.month = sp.month)"""


def monthly(m: Model):
    g = intensity(m).groupBy("initiating_country", "month").agg(F.sum("raw_docs").alias("n"))
    return S.zero_filled(g, K, "n", "1996-01-01", "2000-12-01")


query("rolling_mean", MON + " SELECT *, round(avg(y) OVER (PARTITION BY initiating_country ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS mean FROM zf", "pi")(
    lambda m: S.rolling_mean(monthly(m), K))


def segmented(keys: str, source: str, least_total: int) -> str:
    """CTEs of the three rounds of binary segmentation over `source` (keys, month, y), and the cuts."""
    out = [f"s0 AS (SELECT * FROM (SELECT {keys}, month, y, 0 AS seg, CAST(NULL AS DOUBLE) AS pre, CAST(NULL AS DOUBLE) AS post, CAST(NULL AS DOUBLE) AS cz, sum(y) OVER (PARTITION BY {keys}) AS total FROM {source}) WHERE total >= {least_total})"]
    for r in range(3):
        b = f"OVER (PARTITION BY {keys}, seg ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        w = f"OVER (PARTITION BY {keys}, seg)"
        out += [
            f"a{r} AS (SELECT *, count(*) {b} AS n1, sum(y) {b} AS s1, sum(y * y) {b} AS q1, count(*) {w} AS n, sum(y) {w} AS s, sum(y * y) {w} AS q FROM s{r})",
            f"p{r} AS (SELECT *, s1 / n1 AS m1, (s - s1) / (n - n1) AS m2, CASE WHEN n1 >= 3 AND n - n1 >= 3 THEN (q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1)) / greatest(n - 2, 1) END AS p FROM a{r})",
            f"z{r} AS (SELECT *, CASE WHEN p > 1e-12 THEN round(abs(m1 - m2) / sqrt(p * (1.0::DOUBLE / n1 + 1.0::DOUBLE / (n - n1))), 9) END AS z FROM p{r})",
            f"g{r} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN z >= 2.5 THEN z END DESC NULLS LAST, seg, month) AS k FROM z{r})",
            f"b{r} AS (SELECT {keys}, z AS bz, seg AS bseg, month AS bm FROM g{r} WHERE k = 1 AND z >= 2.5)",
            f"s{r + 1} AS (SELECT {keys}, month, y, CASE WHEN seg = bseg THEN CASE WHEN month >= bm THEN {2 * r + 2} ELSE {2 * r + 1} END ELSE seg END AS seg, CASE WHEN seg = bseg AND month = bm THEN m1 ELSE pre END AS pre, CASE WHEN seg = bseg AND month = bm THEN m2 ELSE post END AS post, CASE WHEN seg = bseg AND month = bm THEN z ELSE cz END AS cz FROM z{r} LEFT JOIN b{r} USING ({keys}))",
        ]
    return ", ".join(out) + f" SELECT {keys}, month AS cp_month, round(pre, 1) AS pre_mean, round(post, 1) AS post_mean, CASE WHEN post > pre THEN 'surge' ELSE 'decline' END AS direction, CASE WHEN pre > 0 THEN round(post / pre, 2) END AS magnitude, round(cz, 2) AS z FROM s3 WHERE cz IS NOT NULL"


query("changepoints_by_actor", MON + ", " + segmented("initiating_country", "zf", 50), "pi")(lambda m: S.changepoints(monthly(m), K))
METRICS = """mt AS (SELECT initiating_country, recipient_country AS recipient, month, 'third_party_docs' AS metric, CAST(sum(third_docs) AS DOUBLE) AS n FROM pi GROUP BY 1, 2, 3
  UNION ALL SELECT initiating_country, recipient_country, month, 'raw_docs', CAST(sum(raw_docs) AS DOUBLE) FROM pi GROUP BY 1, 2, 3),
sp AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS month),
zf AS (SELECT i.initiating_country, i.recipient, i.metric, sp.month, coalesce(n, 0) AS y FROM (SELECT DISTINCT initiating_country, recipient, metric FROM mt) i CROSS JOIN sp LEFT JOIN mt USING (initiating_country, recipient, metric, month))"""


@query("changepoints", METRICS + ", " + segmented("initiating_country, recipient, metric", "zf", 20), "pi")
def changepoints(m: Model):
    """Month series of each pair and metric that has twenty documents or more."""
    p = intensity(m).groupBy("initiating_country", F.col("recipient_country").alias("recipient"), "month").agg(F.sum("third_docs").alias("third_party_docs"), F.sum("raw_docs").alias("raw_docs"))
    long = p.unpivot(["initiating_country", "recipient", "month"], ["third_party_docs", "raw_docs"], "metric", "n")
    keys = ["initiating_country", "recipient", "metric"]
    return S.changepoints(S.zero_filled(long, keys, "n", "1996-01-01", "2000-12-01"), keys, 20.0)


query("prior_period", """SELECT DATE '2024-01-10' - 20 - 1 AS prior_start, DATE '2024-01-10' - 1 AS prior_end, count(*) AS n
FROM dem WHERE mention_date BETWEEN DATE '2024-01-10' - 21 AND DATE '2024-01-09'""", "dem")(
    lambda m: m.dem.where(F.col("mention_date").between(*S.prior_period("2024-01-10", "2024-01-30")))
    .agg(F.count("*").alias("n"))
    .select(S.prior_period("2024-01-10", "2024-01-30")[0].alias("prior_start"), S.prior_period("2024-01-10", "2024-01-30")[1].alias("prior_end"), "n")
)
query("category_spike", """g AS (SELECT category, count(DISTINCT doc_id) FILTER (WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31') AS current, count(DISTINCT doc_id) FILTER (WHERE date BETWEEN DATE '1998-01-29' AND DATE '1998-02-28') AS prior
  FROM rb GROUP BY 1), c AS (SELECT *, round((current - prior) / greatest(CAST(prior AS DOUBLE), 0.5), 6) AS change
  FROM g) SELECT * FROM c WHERE current >= 1 AND change >= -1.0""", "rb")(
    lambda m: S.category_spike(base(m), "1998-03-01", "1998-03-31", 1, -1.0))
query("materiality_outliers", """s AS (SELECT count(material_score) AS n, avg(CAST(material_score AS DOUBLE)) AS m, stddev_samp(CAST(material_score AS DOUBLE)) AS s
  FROM ce) SELECT id, round((CAST(material_score AS DOUBLE) - m) / s.s, 6) AS z
FROM ce, s WHERE material_score IS NOT NULL AND n >= 5 AND round((CAST(material_score AS DOUBLE) - m) / s.s, 6) >= 1.5
ORDER BY z DESC, id LIMIT 6""", "ce")(
    lambda m: S.materiality_outliers(m.ce))
CC = "c AS (SELECT initiating_country, count(DISTINCT doc_id) AS n_docs FROM rb GROUP BY 1)"
query("rank_in_cohort", CC + """, s AS (SELECT quantile_cont(n_docs, 0.5) AS median, avg(n_docs) AS mean, count(*) AS n
  FROM c) SELECT initiating_country, n_docs, CAST(row_number() OVER (ORDER BY n_docs DESC, initiating_country) AS INT) AS rank, round(100.0::DOUBLE * (rank() OVER (ORDER BY n_docs) - 1) / s.n, 6) AS percentile, CAST(median AS DOUBLE) AS median, round(mean, 6) AS mean, round((n_docs - median) / median, 6) AS vs_median
FROM c, s""", "rb")(
    lambda m: S.rank_in_cohort(N.count_docs(base(m), K), "initiating_country", "n_docs"))
EDAY = "ed AS (SELECT mention_date AS day, ce.initiating_country, CAST(sum(article_count) AS BIGINT) AS n FROM dem JOIN ce ON ce.id = dem.canonical_event_id GROUP BY 1, 2)"


def event_daily(m: Model):
    return m.dem.join(m.ce.select(F.col("id").alias("canonical_event_id"), "initiating_country"), "canonical_event_id").groupBy(F.col("mention_date").alias("day"), "initiating_country").agg(F.sum("article_count").alias("n"))


SURGE = """r AS (SELECT *, row_number() OVER (PARTITION BY initiating_country ORDER BY day DESC) AS r
  FROM ed WHERE day <= DATE '2024-01-29' AND day > DATE '2024-01-29' - 30),
g AS (SELECT initiating_country, count(*) AS c, max(n) FILTER (WHERE r = 1) AS latest, avg(n) FILTER (WHERE r > 1) AS m, stddev_pop(n) FILTER (WHERE r > 1) AS s
  FROM r GROUP BY 1) SELECT initiating_country, latest, round(m, 6) AS mean, round((latest - m) / s, 6) AS z
FROM g WHERE c >= 5 AND s > 0 AND round((latest - m) / s, 6) >= -5"""
query("alert_volume_surge", EDAY + ", " + SURGE, "ce")(lambda m: S.alert_surge(event_daily(m), "n", "2024-01-29", z=-5.0, keys=K))
query("alert_materiality_spike", """ed AS (SELECT period_start AS day, initiating_country, avg(CAST(material_score AS DOUBLE)) AS n
  FROM es WHERE material_score IS NOT NULL GROUP BY 1, 2), """ + SURGE, "es")(
    lambda m: S.alert_surge(m.es.where("material_score IS NOT NULL").groupBy(F.col("period_start").alias("day"), "initiating_country").agg(F.avg(F.col("material_score").cast("double")).alias("n")), "n", "2024-01-29", z=-5.0, keys=K))
query("alert_new_entity", """n AS (SELECT entity FROM cen WHERE first_mention_date > DATE '2024-01-01')
SELECT count(*) AS n, coalesce((SELECT string_agg(entity, ',' ORDER BY entity) FROM (SELECT entity
    FROM n ORDER BY entity LIMIT 10)), '') AS names FROM n""", "cen")(
    lambda m: S.alert_new(m.cen, "2024-01-01", "entity", "first_mention_date"))
query("alert_new_event", """n AS (SELECT CAST(id AS VARCHAR) AS id FROM ce WHERE first_mention_date > DATE '2024-01-01')
SELECT count(*) AS n, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM n
    ORDER BY id LIMIT 10)), '') AS names FROM n""", "ce")(
    lambda m: S.alert_new(m.ce.withColumn("id", F.col("id").cast("string")), "2024-01-01", "id", "first_mention_date"))
#: From v (canonical_event_id, d, b: block before merging): short blocks join others, long ones are cut into windows from each window's first day.
BLOCKS = """nn AS (SELECT *, count(*) OVER (PARTITION BY canonical_event_id, b) AS n FROM v),
mm AS (SELECT *, max(CASE WHEN n >= 3 OR b = 0 THEN b END) OVER (PARTITION BY canonical_event_id ORDER BY d) AS m FROM nn),
mk AS (SELECT *, count(*) OVER (PARTITION BY canonical_event_id, m) AS k, min(CASE WHEN m > 0 THEN m END) OVER (PARTITION BY canonical_event_id) AS nx FROM mm),
bq AS (SELECT canonical_event_id, d, CASE WHEN m = 0 AND k < 3 THEN coalesce(nx, m) ELSE m END AS q FROM mk),
sp AS (SELECT canonical_event_id, q, min(d) AS d0, max(d) - min(d) > 180 AS long FROM bq GROUP BY 1, 2),
af AS (SELECT x.canonical_event_id, x.q, x.d, min(y.d) AS nd FROM bq x JOIN sp USING (canonical_event_id, q) JOIN bq y ON y.canonical_event_id = x.canonical_event_id AND y.q = x.q AND y.d >= x.d + 90 WHERE sp.long GROUP BY 1, 2, 3),
st AS (SELECT canonical_event_id, q, d0 AS d FROM sp UNION ALL SELECT st.canonical_event_id, st.q, af.nd FROM st JOIN af ON af.canonical_event_id = st.canonical_event_id AND af.q = st.q AND af.d = st.d),
wn AS (SELECT canonical_event_id, d, q, (SELECT count(*) FROM st WHERE st.canonical_event_id = bq.canonical_event_id AND st.q = bq.q AND st.d <= bq.d) AS w FROM bq)
SELECT canonical_event_id, d AS mention_date, CAST(dense_rank() OVER (PARTITION BY canonical_event_id ORDER BY q, w) - 1 AS INT) AS block FROM wn"""
query("split_by_gap", """RECURSIVE m AS (SELECT canonical_event_id, CAST(mention_date + CAST(day(mention_date) // 10 AS INT) * 40 AS DATE) AS d FROM dem),
ap AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY canonical_event_id ORDER BY d) >= 30 THEN 1 ELSE 0 END AS g FROM m),
v AS (SELECT canonical_event_id, d, sum(g) OVER (PARTITION BY canonical_event_id ORDER BY d) AS b FROM ap), """ + BLOCKS, "dem")(
    lambda m: S.split_by_gap(m.dem.withColumn("mention_date", F.date_add("mention_date", ((F.dayofmonth("mention_date") / 10).cast("int") * 40)))))
VP = """p AS (SELECT x.country, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine
  FROM vectors x JOIN vectors y ON x.country = y.country AND x.vec_id < y.vec_id),
q AS (SELECT * FROM p WHERE cosine >= 0.35)"""


def near(m: Model):
    return G.similar_pairs(m.vectors, ["country"], 0.35)


query("cosine_similarity", VP + " SELECT * FROM q", "vectors")(near)
query("connected_components", "RECURSIVE " + VP + """, s AS (SELECT a, b FROM q UNION SELECT b, a FROM q), r AS (SELECT a AS node, a AS m
  FROM s UNION SELECT s.a, r.m FROM r JOIN s ON s.b = r.node) SELECT node, min(m) AS component
FROM r GROUP BY 1""", "vectors")(
    lambda m: G.connected_components(G.similar_pairs(m.vectors, ["country"], 0.35, links=True)))
query("residual_duplicates", VP + """ SELECT q.a, q.b, q.cosine FROM q JOIN vectors x ON x.vec_id = q.a
JOIN vectors y ON y.vec_id = q.b WHERE greatest(x.day - y.day, y.day - x.day) <= 10""", "vectors")(
    lambda m: G.residual_duplicates(near(m), m.vectors.select(F.col("vec_id").alias("id"), F.col("day").alias("first_day"), F.col("day").alias("last_day")), 10))


query("link_entities_to_events", "SELECT DISTINCT den.entity, f.master FROM den JOIN fdocs f ON f.doc_id = den.doc_id", "den", "fdocs")(
    lambda m: G.link_entities_to_events(m.den, E.family_docs(m.ce, m.event_docs)))
query("event_entities", "SELECT DISTINCT l.es_id, den.entity FROM links l JOIN den ON den.doc_id = l.doc_id", "links", "den")(
    lambda m: m.links.join(m.den.select("entity", "doc_id").distinct(), "doc_id")
    .select("es_id", "entity")
    .distinct())
query("entity_lookup", "SELECT entity, total_documents FROM cen WHERE entity ILIKE '%c%' ORDER BY lower(entity) = 'c' DESC, total_documents DESC, entity LIMIT 10", "cen")(
    lambda m: G.entity_lookup(m.cen, "c", 10)
    .select("entity", "total_documents"))
query("entity_type_distribution", "SELECT entity_type, count(*) AS n FROM cen GROUP BY 1", "cen")(lambda m: m.cen.groupBy("entity_type").agg(F.count("*").alias("n")))
query("entity_explorer", "SELECT entity, total_documents FROM cen WHERE total_documents >= 2 ORDER BY total_documents DESC, entity LIMIT 20", "cen")(
    lambda m: E.top_k(m.cen.where("total_documents >= 2"), [F.desc("total_documents"), F.asc("entity")], 20)
    .select("entity", "total_documents"))
query("top_entities_in_period", """SELECT entity, count(DISTINCT doc_id) AS n_docs, count(DISTINCT mention_date) AS n_days
FROM den WHERE mention_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""", "den")(
    lambda m: E.top_k(m.den.where("mention_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-15'").groupBy("entity").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("mention_date").alias("n_days")), [F.desc("n_docs"), F.asc("entity")], 15))
query("cross_recipient_reach", "SELECT id, count(*) AS reach FROM rcounts GROUP BY 1", "rcounts")(
    lambda m: m.ce_maps.where("primary_recipients IS NOT NULL")
    .select("id", F.size(F.map_keys("primary_recipients")).cast("long").alias("reach")))
query("new_entities", """SELECT entity, total_documents, round(least(1.0, total_documents / 25.0::DOUBLE), 6) AS magnitude
FROM cen WHERE first_mention_date >= DATE '2024-01-01' AND total_documents >= 3
ORDER BY total_documents DESC, entity LIMIT 12""", "cen")(
    lambda m: E.top_k(m.cen.where("first_mention_date >= DATE'2024-01-01' AND total_documents >= 3"), [F.desc("total_documents"), F.asc("entity")], 12)
    .select("entity", "total_documents", F.round(F.least(F.lit(1.0), F.col("total_documents") / 25), 6).alias("magnitude")))



# retrieval
TOKENS = """t AS (SELECT doc_id, 'B' AS field, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS term FROM documents{more})
SELECT term, doc_id, field, count(*) AS tf FROM t WHERE term <> '' GROUP BY 1, 2, 3"""
query("build_postings_body", TOKENS.replace("{more}", ""))(lambda m: R.build_postings(m.table("documents").select("doc_id", "text"), "doc_id", {"text": "B"}))
query("build_postings", TOKENS.replace("{more}", " UNION ALL SELECT doc_id, 'A', unnest(regexp_split_to_array(lower(coalesce(split_part(text, '.', 1), '')), '[^a-z0-9]+')) FROM documents"))(
    lambda m: R.build_postings(m.table("documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), "text"), "doc_id", {"title": "A", "text": "B"}))


def asked_vectors(m: Model):
    return m.vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


query("vector_search", """s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT *
FROM r WHERE rank <= 5""")(
    lambda m: R.vector_search(asked_vectors(m), m.vectors, 5))
query("vector_search_filtered", """s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, vectors v WHERE q.vec_id % 100 = 0 AND v.country = 'NATION_3' AND v.day >= DATE '2024-01-10'), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT *
FROM r WHERE rank <= 5""", "vectors")(
    lambda m: R.vector_search(asked_vectors(m), m.vectors, 5, "country = 'NATION_3' AND day >= DATE'2024-01-10'"))


@query("vector_search_approx")
def vector_search_approx(m: Model):
    """For each query, how many of the exact ten nearest the inverted index finds, without a filter and under one that a few rows pass; and how many rows it gives."""
    index = VectorIndex.build(m.vectors, new_dir(m.spark, "vector-index"))
    out = None
    for name, filters in (("all", None), ("few", "country = 'NATION_3' AND day >= DATE'2024-02-05'")):
        exact = R.vector_search(asked_vectors(m), m.vectors, 10, filters).select("query_id", "vec_id", F.lit(1).alias("exact"))
        found = R.vector_search(asked_vectors(m), m.vectors, 10, filters, approx=True, index=index).select("query_id", "vec_id", F.lit(1).alias("found"))
        one = exact.join(found, ["query_id", "vec_id"], "full").groupBy("query_id").agg(F.lit(name).alias("filter"), F.lit(index.needed(10, filters)).alias("probes"), F.count("exact").alias("n_exact"), F.count("found").alias("n_found"), (F.sum(F.col("exact") * F.col("found")) / F.count("exact")).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out
