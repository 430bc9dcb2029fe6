"""Queries of scalar expressions, labels, raw events, data quality and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import quality as Q
from .model import Model
from .registry import query

# labels packed as the exports have them
PACK = "pk AS (SELECT doc_id, concat(' ', string_agg(category, ' ; ' ORDER BY category), ';;') AS labels FROM cat GROUP BY 1)"


def packed(m: Model):
    return m.cat.groupBy("doc_id").agg(F.concat(F.lit(" "), F.array_join(F.array_sort(F.collect_set("category")), " ; "), F.lit(";;")).alias("labels"))


query("split_multi", "SELECT doc_id, count(*) AS n_labels FROM cat GROUP BY 1", "cat")(
    lambda m: packed(m)
    .select("doc_id", F.size(C.split_multi(F.col("labels"))).cast("long").alias("n_labels")))
query("flatten_labels", "SELECT doc_id, category FROM cat", "cat")(
    lambda m: packed(m)
    .select("doc_id", F.explode(F.array_distinct(C.split_multi(F.col("labels")))).alias("category")))
query("flatten_raw_events", "SELECT doc_id, event_name AS name FROM raw_events UNION SELECT doc_id, specific_event_name FROM raw_events WHERE specific_event_name IS NOT NULL", "raw_events")(
    lambda m: m.raw_events.groupBy("doc_id")
    .agg(F.array_join(F.collect_set("event_name"), ";").alias("e"), F.array_join(F.collect_set("specific_event_name"), ";").alias("p"))
    .select("doc_id", F.explode(F.array_distinct(F.concat(C.split_multi(F.col("e")), C.split_multi(F.col("p"))))).alias("name"))
)
query("normalize_na", "SELECT doc_id, CASE WHEN medium = 'P' THEN NULL ELSE source_name END AS source FROM d", "d")(
    lambda m: m.d.select("doc_id", C.normalize_na(F.when(F.col("medium") == "P", " N/A ").otherwise(F.concat(F.lit(" "), "source_name"))).alias("source")))
query("parse_flexible_date", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE date END AS day FROM d", "d")(
    lambda m: m.d.select("doc_id", C.parse_flexible_date(F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("date").cast("string"), F.lit("T10:00:00Z"))).when(F.col("doc_id") % 5 == 1, F.col("date").cast("string")).when(F.col("doc_id") % 5 == 2, F.date_format("date", "MM/dd/yyyy")).when(F.col("doc_id") % 5 == 3, F.date_format("date", "d MMMM yyyy")).otherwise("soon")).alias("day"))
)
query("clean_subcategory", "SELECT DISTINCT p_brand AS raw, p_brand AS clean FROM part")(
    lambda m: m.table("part")
    .select("p_brand")
    .distinct()
    .select(F.col("p_brand").alias("raw"), C.clean_subcategory(F.concat(F.lit("B. Other-"), "p_brand")).alias("clean")))
query("normalize_event_name", "SELECT DISTINCT p_name AS raw, trim(regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM part")(
    lambda m: m.table("part")
    .select("p_name")
    .distinct()
    .select(F.col("p_name").alias("raw"), C.normalize_event_name(F.concat(F.lit("3rd Summit "), "p_name", F.lit("!"))).alias("name")))
query("normalize_title_key", "SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM d", "d")(
    lambda m: m.d.select("doc_id", C.normalize_title_key(F.col("title")).alias("key")))
query("is_generic_name", "SELECT entity, entity ILIKE 'c%' OR split_part(entity, '_', 2) = '1' AS generic FROM cen", "cen")(
    lambda m: m.cen.select("entity", (F.col("entity").rlike("(?i)^c") | (F.element_at(F.split("entity", "_"), -1) == "1")).alias("generic")))
query("generic_name_rate", "SELECT round(avg(CASE WHEN regexp_matches(event_name, '[0-9]$') THEN 1.0 ELSE 0.0 END), 6) AS rate FROM raw_events", "raw_events")(
    lambda m: m.raw_events.agg(F.round(F.avg(F.col("event_name").rlike("[0-9]$").cast("double")), 6).alias("rate")))
query("rejection_reason", """SELECT d.doc_id, CASE WHEN medium = 'P' THEN 'not salient' WHEN ic.initiating_country NOT IN {INF} THEN 'initiator' WHEN NOT EXISTS (SELECT 1
  FROM rc WHERE rc.doc_id = d.doc_id AND recipient_country IN {REC}) THEN 'recipient' WHEN date < DATE '1996-01-01' OR date >= DATE '2001-01-01' THEN 'date' END AS reason
FROM d JOIN ic ON ic.doc_id = d.doc_id""", "d", "rc")(
    lambda m: m.d.join(m.ic, "doc_id").join(m.rc.groupBy("doc_id").agg(F.collect_set("recipient_country").alias("rs")), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("medium") == "P", "not salient").when(~F.col("initiating_country").isin(*m.scope.influencers), "initiator").when(~F.coalesce(F.arrays_overlap("rs", F.array(*map(F.lit, m.scope.recipients))), F.lit(False)), "recipient").when(~((F.col("date") >= F.lit(m.scope.start).cast("date")) & (F.col("date") < F.lit(m.scope.end).cast("date"))), "date").alias("reason"),
    )
)
query("eligible_doc_links", """SELECT count(*) AS n FROM d JOIN ic ON ic.doc_id = d.doc_id WHERE medium <> 'P' AND ic.initiating_country IN {INF} AND date >= DATE '1996-01-01' AND date < DATE '2001-01-01' AND EXISTS (SELECT 1
  FROM rc WHERE rc.doc_id = d.doc_id AND recipient_country IN {REC})""", "d", "rc")(
    lambda m: m.d.join(m.ic, "doc_id")
    .where((F.col("medium") != "P") & F.col("initiating_country").isin(*m.scope.influencers) & (F.col("date") >= F.lit(m.scope.start).cast("date")) & (F.col("date") < F.lit(m.scope.end).cast("date")))
    .join(m.rc.where(F.col("recipient_country").isin(*m.scope.recipients)).select("doc_id"), "doc_id", "left_semi")
    .agg(F.count("*").alias("n"))
)
query("iso_week_bounds", """SELECT DISTINCT CAST(strftime(date, '%G-W%V') AS VARCHAR) AS week, CAST(date_trunc('week', date) AS DATE) AS monday, CAST(date_trunc('week', date) AS DATE) + 6 AS sunday
FROM d""", "d")(
    lambda m: m.d.select(F.concat(F.year(F.date_add(F.trunc("date", "week"), 3)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("date").cast("string"), 2, "0")).alias("week"))
    .distinct()
    .select("week", C.iso_week_start(F.col("week")).alias("monday"), F.date_add(C.iso_week_start(F.col("week")), 6).alias("sunday"))
)
query("build_search_links", """n AS (SELECT source_name, doc_id, (row_number() OVER (PARTITION BY source_name ORDER BY doc_id) - 1) // 80 AS chunk
  FROM d) SELECT source_name, chunk, string_agg(concat('\"', doc_id, '\"'), '+OR+'
  ORDER BY doc_id) AS url FROM n GROUP BY 1, 2""", "d")(
    lambda m: m.d.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("source_name").orderBy("doc_id")) - 1) / 80))
    .groupBy("source_name", "chunk")
    .agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))), "+OR+").alias("url"))
)
query("build_citation", "SELECT doc_id, concat('[', source_name, '] ', doc_id, ': ', title, ', ', day(date), ' ', strftime(date, '%B %Y')) AS citation FROM d", "d")(
    lambda m: m.d.select("doc_id", C.citation(F.col("source_name"), F.col("doc_id"), F.col("title"), F.col("date")).alias("citation")))
query("spread_docs_over_days", """SELECT id, k AS day, CAST(total_articles // 7 + CASE WHEN k = 0 THEN total_articles % 7 ELSE 0 END AS BIGINT) AS n
FROM ce, (SELECT CAST(unnest(range(7)) AS INT) AS k)""", "ce")(
    lambda m: m.ce.select("id", "total_articles", F.posexplode(F.sequence(F.lit(0), F.lit(6))).alias("day", "_"))
    .select("id", "day", (F.floor(F.col("total_articles") / 7) + F.when(F.col("day") == 0, F.col("total_articles") % 7).otherwise(0)).cast("long").alias("n")))
query("seeded_sample", "SELECT doc_id FROM d ORDER BY md5(concat(CAST(doc_id AS VARCHAR), 'seed')), doc_id LIMIT 50", "d")(
    lambda m: m.d.select("doc_id")
    .orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("seed"))), "doc_id")
    .limit(50))
query("temporal_anchor", """SELECT least(DATE '2000-06-01', max(date)) AS anchor, min(date) AS first_day, max(date) AS last_day, count(*) AS n, CAST(DATE '2002-01-01' - max(date) AS BIGINT) AS days_behind
FROM d""", "d")(
    lambda m: m.d.agg(F.least(F.lit("2000-06-01").cast("date"), F.max("date")).alias("anchor"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n"), F.datediff(F.lit("2002-01-01").cast("date"), F.max("date")).cast("long").alias("days_behind")))
query("freshness", "SELECT CAST(DATE '2024-03-01' - max(period_start) AS BIGINT) AS days FROM es", "es")(
    lambda m: m.es.agg(F.datediff(F.lit("2024-03-01").cast("date"), F.max("period_start")).cast("long").alias("days")))
query("merge_count_maps", "SELECT id, key, CAST(2 * n AS BIGINT) AS n FROM rcounts UNION ALL SELECT id, key, n FROM ccounts", "rcounts", "ccounts")(
    lambda m: m.ce_maps.select("id", F.explode(C.merge_count_maps(C.merge_count_maps(F.col("primary_recipients"), F.col("primary_recipients")), F.col("primary_categories"))).alias("key", "n")))
query("union_arrays_ordered", """k AS (SELECT id, key, n, 0 AS side FROM rcounts UNION ALL SELECT id, key, n, 1 FROM ccounts), f AS (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY side) AS r
  FROM k) SELECT id, count(DISTINCT key) AS n, string_agg(key, ',' ORDER BY side, n DESC, key) AS keys
FROM f WHERE r = 1 GROUP BY 1""", "rcounts", "ccounts")(
    lambda m: m.ce_maps.select("id", C.union_arrays_ordered(C.ranked_keys(F.col("primary_recipients")), C.ranked_keys(F.col("primary_categories"))).alias("keys"))
    .select("id", F.size("keys").cast("long").alias("n"), F.array_join("keys", ",").alias("keys")))
query("missing_keys", "SELECT DISTINCT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM dem_docs)", "d", "dem_docs")(lambda m: Q.missing_keys(m.d, m.event_docs, "doc_id"))
query("idempotent_append", "SELECT doc_id, date FROM d", "d")(
    lambda m: Q.idempotent_append(m.d.select("doc_id", "date").unionByName(m.d.select("doc_id", "date")), m.d.where("doc_id % 3 = 0").select("doc_id", "date"), ["doc_id"]))
query("upsert_latest", "SELECT doc_id, date, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE medium END AS medium FROM d", "d")(
    lambda m: Q.upsert_latest(m.d.select("doc_id", "date", "medium"), m.d.where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("medium")), ["doc_id"], ["medium"]))
query("build_daily_mentions", """SELECT canonical_event_id, mention_date, CASE WHEN canonical_event_id % 4 = 0 THEN article_count + 1 ELSE article_count END AS article_count
FROM dem""", "dem")(
    lambda m: Q.upsert_latest(m.dem.select("canonical_event_id", "mention_date", "article_count"), m.dem.where("canonical_event_id % 4 = 0").select("canonical_event_id", "mention_date", (F.col("article_count") + 1).alias("article_count")), ["canonical_event_id", "mention_date"], ["article_count"])
)
query("dedupe_exact", "SELECT title, min(doc_id) AS doc_id FROM d GROUP BY 1", "d")(lambda m: Q.dedupe_exact(m.d.select("title", "doc_id"), "title", ["doc_id"])[0])
query("dangling_refs", """SELECT 'missing documents' AS metric, count(DISTINCT doc_id) AS n
FROM dem_docs WHERE doc_id NOT IN (SELECT doc_id FROM d WHERE doc_id % 7 <> 0)
UNION ALL SELECT 'absent masters', count(*) FROM ce WHERE master_event_id IS NOT NULL AND master_event_id NOT IN (SELECT id
  FROM ce) UNION ALL SELECT 'events without mentions', count(*)
FROM ce WHERE id NOT IN (SELECT canonical_event_id FROM dem_docs)""", "ce", "d")(
    lambda m: Q.dangling_refs(m.event_docs, m.ce, m.d.where("doc_id % 7 <> 0")))
query("pipeline_coverage", """SELECT 'documents' AS metric, count(*) AS n FROM d UNION ALL SELECT 'masters', count(*)
FROM ce WHERE master_event_id IS NULL UNION ALL SELECT 'children', count(*)
FROM ce WHERE master_event_id IS NOT NULL UNION ALL SELECT 'mentions', count(*)
FROM dem""", "d", "ce")(
    lambda m: Q.metrics({"documents": m.d, "masters": m.ce.where("master_event_id IS NULL"), "children": m.ce.where("master_event_id IS NOT NULL"), "mentions": m.dem}))
query("label_vocabulary_drift", """SELECT round(CAST(count(*) FILTER (WHERE category NOT IN {CAT}) AS DOUBLE) / count(*), 6) AS share, count(DISTINCT category) FILTER (WHERE category NOT IN {CAT}) AS distinct_oov
FROM cat""", "cat")(
    lambda m: Q.vocabulary_drift(m.cat, "category", m.scope.categories))
query("denorm_mismatch", "SELECT DISTINCT doc_id FROM cat WHERE category = 'LARGE'", "cat")(
    lambda m: Q.denorm_mismatch(packed(m).select("doc_id", C.split_multi(F.col("labels")).alias("values")), m.cat.where("category <> 'LARGE'"), "category"))
BUCKET = "CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' WHEN n <= 50 THEN '26-50' WHEN n <= 100 THEN '51-100' WHEN n <= 500 THEN '101-500' ELSE '500+' END"
query("raw_event_frequency_buckets", f"g AS (SELECT event_name, count(DISTINCT doc_id) AS n FROM raw_events GROUP BY 1) SELECT {BUCKET} AS bucket, count(*) AS names, CAST(sum(n) AS BIGINT) AS docs, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct_names, round(100.0::DOUBLE * sum(n) / sum(sum(n)) OVER (), 2) AS pct_docs FROM g GROUP BY 1", "raw_events")(
    lambda m: m.raw_events.groupBy("event_name")
    .agg(F.count_distinct("doc_id").alias("n"))
    .groupBy(F.expr(BUCKET).alias("bucket"))
    .agg(F.count("*").alias("names"), F.sum("n").alias("docs"))
    .withColumns({"pct_names": F.round(100.0 * F.col("names") / F.sum("names").over(W.partitionBy()), 2), "pct_docs": F.round(100.0 * F.col("docs") / F.sum("docs").over(W.partitionBy()), 2)})
)
query("raw_event_lifespan", """g AS (SELECT r.event_name, max(d.date) - min(d.date) AS s FROM raw_events r
  JOIN d ON d.doc_id = r.doc_id GROUP BY 1) SELECT CASE WHEN s = 0 THEN 'one day' WHEN s <= 7 THEN 'week' WHEN s <= 30 THEN 'month' ELSE 'longer' END AS bucket, count(*) AS names
FROM g GROUP BY 1""", "raw_events", "d")(
    lambda m: m.raw_events.join(m.d.select("doc_id", "date"), "doc_id")
    .groupBy("event_name")
    .agg(F.datediff(F.max("date"), F.min("date")).alias("s"))
    .groupBy(F.when(F.col("s") == 0, "one day").when(F.col("s") <= 7, "week").when(F.col("s") <= 30, "month").otherwise("longer").alias("bucket"))
    .agg(F.count("*").alias("names"))
)
query("token_frequency", """g AS (SELECT event_name, count(DISTINCT doc_id) AS n FROM raw_events
  GROUP BY 1), t AS (SELECT unnest(string_split(lower(event_name), ' ')) AS token, n
  FROM g) SELECT token, count(*) AS occurrences, CAST(sum(n) AS BIGINT) AS docs
FROM t WHERE len(token) > 3 GROUP BY 1""", "raw_events")(
    lambda m: m.raw_events.groupBy("event_name")
    .agg(F.count_distinct("doc_id").alias("n"))
    .select("n", F.explode(F.split(F.lower("event_name"), r"\s+")).alias("token"))
    .where(F.length("token") > 3)
    .groupBy("token")
    .agg(F.count("*").alias("occurrences"), F.sum("n").alias("docs"))
)
VAR = "CASE WHEN doc_id % 2 = 0 THEN upper(event_name) ELSE event_name END"
query("case_variants", f"SELECT lower(trim(name)) AS key, count(DISTINCT name) AS n FROM (SELECT {VAR} AS name FROM raw_events) GROUP BY 1 HAVING count(DISTINCT name) > 1", "raw_events")(
    lambda m: m.raw_events.select(F.expr(VAR).alias("name"))
    .groupBy(F.lower(F.trim("name")).alias("key"))
    .agg(F.count_distinct("name").alias("n"))
    .where("n > 1"))
query("label_prf", """g AS (SELECT doc_id, category AS label FROM cat), p AS (SELECT doc_id, category AS label
  FROM cat WHERE doc_id % 3 <> 0 UNION SELECT doc_id, 'EXTRA' FROM cat),
j AS (SELECT g.doc_id AS gd, p.doc_id AS pd FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.label = p.label),
c AS (SELECT count(*) FILTER (WHERE gd IS NOT NULL AND pd IS NOT NULL) AS tp, count(pd) AS np, count(gd) AS ng
  FROM j) SELECT tp, round(tp / CAST(np AS DOUBLE), 6) AS precision, round(tp / CAST(ng AS DOUBLE), 6) AS recall, round(2 * tp / CAST(np + ng AS DOUBLE), 6) AS f1
FROM c""", "cat")(
    lambda m: Q.label_prf(m.cat.withColumnRenamed("category", "label"), m.cat.where("doc_id % 3 <> 0").withColumnRenamed("category", "label").unionByName(m.cat.select("doc_id", F.lit("EXTRA").alias("label"))))
)
query("cohens_kappa", """p AS (SELECT quality AS x, toxic AS y FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS same
  FROM p), m AS (SELECT sum(a.c * b.c) AS ab FROM (SELECT x AS k, count(*) AS c FROM p GROUP BY 1) a
  JOIN (SELECT y AS k, count(*) AS c FROM p GROUP BY 1) b ON a.k = b.k)
SELECT round((same / CAST(n AS DOUBLE) - ab / CAST(n * n AS DOUBLE)) / (1 - ab / CAST(n * n AS DOUBLE)), 6) AS kappa
FROM n, m""")(
    lambda m: Q.cohens_kappa(m.table("labels").select(F.col("quality").alias("x"), F.col("toxic").alias("y"))))
AS = "a AS (SELECT vec_id % 12 AS cluster, label AS gold FROM embeddings)"
query("cluster_purity", AS + """, t AS (SELECT cluster, gold, count(*) AS c FROM a GROUP BY 1, 2),
g AS (SELECT cluster, max(c) AS m, sum(c) AS n FROM t GROUP BY 1)
SELECT round(sum(m) / CAST(sum(n) AS DOUBLE), 6) AS purity FROM g""")(
    lambda m: Q.cluster_purity(m.vectors.select((F.col("vec_id") % 12).alias("cluster"), F.col("label").alias("gold"))))
_pc = lambda k, n: f"(SELECT sum(c * (c - 1) / 2.0::DOUBLE) AS {n} FROM (SELECT count(*) AS c FROM a GROUP BY {k}))"
query("pairwise_cluster_prf", AS + f" SELECT round(shared / pred, 6) AS precision, round(shared / real, 6) AS recall, round(2 * shared / (pred + real), 6) AS f1 FROM {_pc('cluster, gold', 'shared')}, {_pc('cluster', 'pred')}, {_pc('gold', 'real')}")(
    lambda m: Q.pairwise_cluster_prf(m.vectors.select((F.col("vec_id") % 12).alias("cluster"), F.col("label").alias("gold"))))
query("spearman_rank", """r AS (SELECT row_number() OVER (ORDER BY total_articles, id) - row_number() OVER (ORDER BY total_mention_days, id) AS d
  FROM ce) SELECT round(1 - 6 * sum(CAST(d * d AS DOUBLE)) / (CAST(count(*) AS DOUBLE) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 6) AS rho
FROM r""", "ce")(
    lambda m: Q.spearman_rank(m.ce.select("id", F.col("total_articles").alias("x"), F.col("total_mention_days").alias("y"))))
query("citation_coverage", """c AS (SELECT id AS claim_id FROM ce), x AS (SELECT canonical_event_id AS claim_id, doc_id
  FROM dem_docs WHERE canonical_event_id % 3 <> 0), t AS (SELECT doc_id, count(*) AS n
  FROM x GROUP BY 1) SELECT (SELECT round(count(*) FILTER (WHERE claim_id IN (SELECT claim_id
    FROM x)) / CAST(count(*) AS DOUBLE), 6) FROM c) AS covered, (SELECT count(*)
  FROM x WHERE doc_id NOT IN (SELECT doc_id FROM d WHERE medium = 'O')) AS outside, (SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 6)
  FROM t) AS dominance""", "ce", "d")(
    lambda m: Q.citation_coverage(m.ce.select(F.col("id").alias("claim_id")), m.event_docs.where("canonical_event_id % 3 <> 0").select(F.col("canonical_event_id").alias("claim_id"), "doc_id"), m.d.where("medium = 'O'"))
)
query("extract_inline_citations", "SELECT doc_id, concat('D', doc_id) AS cited FROM d", "d")(
    lambda m: m.d.select("doc_id", F.explode(C.inline_citations(F.concat(F.lit("see [D"), F.col("doc_id").cast("string"), F.lit("] and [not this one]")))).alias("cited")))
query("source_stance_tally", "SELECT CASE WHEN medium IN ('P', 'O') THEN medium ELSE 'unclassified' END AS stance, count(*) AS n FROM d GROUP BY 1", "d")(
    lambda m: Q.stance_tally(m.d.select(F.col("medium").alias("stance")), ["P", "O"]))
query("source_spread", "SELECT count(DISTINCT source_name) AS sources, count(DISTINCT source_geofocus) AS countries FROM d", "d")(
    lambda m: m.d.agg(F.count_distinct("source_name").alias("sources"), F.count_distinct("source_geofocus").alias("countries")))


def day_pack(m: Model):
    """Documents of a day in the order of their first recipient and category, in chunks of five. Needs two names of a document, and so takes no facts of all."""
    first, second = m.first_names()
    j = m._d().select("doc_id", "date").join(first, "doc_id", "left").join(second, "doc_id", "left")
    order = [F.coalesce(c, F.lit(0)) for c in ("recipient_country", "category")]
    return j.select("date", "doc_id", F.floor((F.row_number().over(W.partitionBy("date").orderBy(*order, "doc_id")) - 1) / 5).cast("long").alias("chunk"))


query("document_day_pack", """f AS (SELECT d.doc_id, d.date, coalesce((SELECT min(recipient_country) FROM rc WHERE rc.doc_id = d.doc_id), 'ZZZ') AS r, coalesce((SELECT min(category)
    FROM cat WHERE cat.doc_id = d.doc_id), 'ZZZ') AS c FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY date
    ORDER BY r, c, doc_id) AS k FROM f) SELECT date, doc_id, CAST((k - 1) // 5 AS BIGINT) AS chunk
FROM n""", "d", "rc", "cat")(day_pack)
