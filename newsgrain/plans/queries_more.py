"""Queries of event and entity construction, names, graphs, themes, series and retrieval, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import contextlib

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bundles as B
from ..operators import construct as K
from ..operators import counts as N
from ..operators import density as D
from ..operators import events as E
from ..operators import facts as P
from ..operators import graph as G
from ..operators import names as M
from ..operators import posting_blocks as X
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import series as S
from ..operators.store import written
from ..streaming import jobs
from .model import Model
from .queries_counts import base
from .queries_events import DOM
from .queries_series import BLOCKS, MON, monthly, segmented
from .registry import query

# ---- events


def lookback_sides(m: Model):
    """Events first seen on or after the second day, and those before it, with what the tiers look at."""
    report = m.ce.where("first_mention_date >= DATE'2024-01-02'").join(B.top_keys(m.category_counts, 1, "c").select("id", F.get("c", F.lit(0)).alias("category")), "id")
    old = m.ce.where("first_mention_date BETWEEN date_sub(DATE'2024-01-02', 90) AND DATE'2024-01-01' AND total_articles >= 2")
    names = m.dem_docs.select(F.col("canonical_event_id").alias("id"), "entity").where("entity RLIKE '^(click|view)_[6-9]$'")
    return report, old, names


LOOK = """cc AS (SELECT id, key AS category FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, key) AS r FROM ccounts) WHERE r = 1),
report AS (SELECT ce.*, cc.category FROM ce JOIN cc ON cc.id = ce.id WHERE first_mention_date >= DATE '2024-01-02'),
old AS (SELECT * FROM ce WHERE first_mention_date BETWEEN DATE '2024-01-02' - 90 AND DATE '2024-01-01' AND total_articles >= 2),
nm AS (SELECT DISTINCT canonical_event_id AS id, entity FROM ent_docs WHERE regexp_matches(entity, '^(click|view)_[6-9]$')),
t1 AS (SELECT o.id AS match_id, min(r.id) AS report_id, 1 AS tier FROM old o JOIN report r ON coalesce(o.master_event_id, o.id) = coalesce(r.master_event_id, r.id) AND o.initiating_country = r.initiating_country GROUP BY 1),
s2 AS (SELECT id, initiating_country FROM (SELECT *, row_number() OVER (PARTITION BY initiating_country ORDER BY material_score DESC NULLS LAST, id) AS k FROM old WHERE master_event_id IS NULL AND id NOT IN (SELECT match_id FROM t1)) WHERE k <= 200),
t2 AS (SELECT match_id, min(report_id) AS report_id, 2 AS tier FROM (SELECT s2.id AS match_id, r.id AS report_id, count(*) AS n FROM s2 JOIN nm a ON a.id = s2.id JOIN nm b ON b.entity = a.entity JOIN report r ON r.id = b.id AND r.initiating_country = s2.initiating_country GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
f0 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2)"""
for _k, _c in enumerate(("ECONOMY", "LARGE", "MEDIUM", "SMALL")):
    LOOK += f""",
f{_k + 1} AS (SELECT * FROM f{_k} UNION ALL SELECT x.id, t.id, 3 FROM (SELECT o.id, o.initiating_country, row_number() OVER (PARTITION BY o.initiating_country ORDER BY o.material_score DESC NULLS LAST, o.id) AS k FROM old o
  WHERE master_event_id IS NULL AND id NOT IN (SELECT match_id FROM f{_k}) AND id IN (SELECT id FROM ccounts WHERE key = '{_c}') AND EXISTS (SELECT 1 FROM rcounts a JOIN rcounts b ON b.key = a.key JOIN report r ON r.id = b.id WHERE a.id = o.id AND r.category = '{_c}' AND r.initiating_country = o.initiating_country)) x
  JOIN (SELECT initiating_country, id FROM (SELECT *, row_number() OVER (PARTITION BY initiating_country ORDER BY coalesce(material_score, 0) DESC, id) AS q FROM report WHERE category = '{_c}') WHERE q = 1) t ON t.initiating_country = x.initiating_country WHERE x.k <= 10)"""
LOOK += """ SELECT tier, report_id, match_id, CAST(place AS INT) AS place
FROM (SELECT f4.*, row_number() OVER (PARTITION BY report_id ORDER BY o.material_score DESC NULLS LAST, match_id) AS place
  FROM f4 JOIN old o ON o.id = f4.match_id) WHERE place <= 5"""


@query("lookback_matches", LOOK, "ce", "ccounts", "rcounts")
def lookback_matches(m: Model):
    return E.lookback_matches(*lookback_sides(m), m.category_counts, m.recipient_counts, m.scope.categories)


_TWO = ("NATION_1", "NATION_3", "NATION_5", "NATION_8", "NATION_11", "NATION_13")


@query("event_scope", DOM + """ SELECT ce.id FROM ce JOIN dom ON dom.id = ce.id WHERE master_event_id IS NULL AND first_mention_date <= DATE '2024-01-20' AND last_mention_date >= DATE '2024-01-10' AND dom.key IN """ + str(_TWO) + " AND ce.id IN (SELECT id FROM ccounts WHERE key = 'ECONOMY')", "ce", "rcounts", "ccounts")
def event_scope(m: Model):
    return B.stacked([E.event_scope(m.ce_maps, start="2024-01-10", end="2024-01-20", recipient=r, category="ECONOMY").select("id") for r in _TWO])


@query("primary_aligned_events", """t AS (SELECT id, CAST(sum(n) AS DOUBLE) AS t, max(n) FILTER (WHERE key <> 'NATION_7') AS o, max(n) FILTER (WHERE key = 'NATION_7') AS n
  FROM rcounts GROUP BY 1) SELECT ce.id FROM ce JOIN t ON t.id = ce.id
WHERE t.n > 0 AND (contains(ce.canonical_name, 'NATION_7') OR t.n / t.t >= 0.4 OR t.o IS NULL OR t.n > t.o)""", "ce", "rcounts")
def primary_aligned_events(m: Model):
    return P.primary_aligned_events(m.ce_maps, "NATION_7").select("id")


KNOWN = """SELECT id, initiating_country, canonical_name AS event_name, first_mention_date AS first_day, CAST(first_mention_date + 9 AS DATE) AS last_day, total_articles AS articles
FROM ce WHERE id % 10 = 0"""
BUILT = f"""ex AS ({KNOWN}), g AS (SELECT DISTINCT ce.initiating_country, ce.canonical_name AS event_name, x.mention_date AS day, x.doc_id FROM dem_docs x JOIN ce ON ce.id = x.canonical_event_id WHERE x.mention_date - DATE '2024-01-01' NOT IN (13, 14, 20)),
dd AS (SELECT initiating_country, event_name, day, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY 1, 2, 3),
k AS (SELECT dd.*, (SELECT min(ex.id) FROM ex WHERE ex.initiating_country = dd.initiating_country AND ex.event_name = dd.event_name AND dd.day BETWEEN ex.first_day AND ex.last_day) AS id FROM dd),
n AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY initiating_country, event_name ORDER BY day) <= 1 THEN 0 ELSE 1 END AS new FROM k WHERE id IS NULL),
pl AS (SELECT initiating_country, event_name, day, n_docs, id, CAST(sum(new) OVER (PARTITION BY initiating_country, event_name ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n UNION ALL SELECT initiating_country, event_name, day, n_docs, id, NULL FROM k WHERE id IS NOT NULL),
a AS (SELECT initiating_country, event_name, id, island, min(day) AS a, max(day) AS z, CAST(sum(n_docs) AS BIGINT) AS n, count(*) AS days FROM pl GROUP BY 1, 2, 3, 4),
dc AS (SELECT DISTINCT pl.initiating_country, pl.event_name, pl.id, pl.island, g.doc_id FROM pl JOIN g ON g.initiating_country = pl.initiating_country AND g.event_name = pl.event_name AND g.day = pl.day),
r AS (SELECT initiating_country, event_name, id, island, count(*) AS mentions, count(DISTINCT recipient_country) AS recipients FROM dc JOIN rc ON rc.doc_id = dc.doc_id GROUP BY 1, 2, 3, 4),
c AS (SELECT initiating_country, event_name, id, island, count(*) AS labels, count(DISTINCT category) AS categories FROM dc JOIN cat ON cat.doc_id = dc.doc_id GROUP BY 1, 2, 3, 4)
SELECT a.initiating_country, a.event_name, a.id, a.island, coalesce(ex.first_day, a.a) AS first_day, CASE WHEN ex.last_day > a.z THEN ex.last_day ELSE a.z END AS last_day, a.n + coalesce(ex.articles, 0) AS total_articles, a.days, r.mentions, r.recipients, c.labels, c.categories FROM a LEFT JOIN ex ON ex.id = a.id
LEFT JOIN r ON r.initiating_country = a.initiating_country AND r.event_name = a.event_name AND r.id IS NOT DISTINCT FROM a.id AND r.island IS NOT DISTINCT FROM a.island LEFT JOIN c ON c.initiating_country = a.initiating_country AND c.event_name = a.event_name AND c.id IS NOT DISTINCT FROM a.id AND c.island IS NOT DISTINCT FROM a.island"""


@query("build_canonical_events", BUILT, "ce", "rc", "cat")
def build_canonical_events(m: Model):
    """Three days are left out, so that events of one name break; every tenth event is known already for its first ten days."""
    who = m.ce.select(F.col("id").alias("canonical_event_id"), "initiating_country", F.col("canonical_name").alias("event_name"))
    gone = F.datediff("mention_date", F.lit("2024-01-01").cast("date")).isin(13, 14, 20)
    groups = m.event_docs.where(~gone).join(who, "canonical_event_id").select("initiating_country", "event_name", F.col("mention_date").alias("day"), "doc_id").distinct()
    existing = m.ce.where("id % 10 = 0").select("id", "initiating_country", F.col("canonical_name").alias("event_name"), F.col("first_mention_date").alias("first_day"), F.date_add("first_mention_date", 9).alias("last_day"), F.col("total_articles").alias("articles"))
    b = K.build_canonical_events(groups, existing, m.rc, m.cat)
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    size = lambda c: F.size(F.map_keys(c)).cast("long")
    shown = {"mentions": total("primary_recipients"), "recipients": size("primary_recipients"), "labels": total("primary_categories"), "categories": size("primary_categories")}
    return b.withColumns({k: F.when(F.col("primary_recipients" if k in ("mentions", "recipients") else "primary_categories").isNotNull(), v) for k, v in shown.items()}).drop("primary_recipients", "primary_categories")


def spread(m: Model):
    """Mentions in three stretches forty days apart, with headlines."""
    day = F.date_add("mention_date", (F.dayofmonth("mention_date") / 10).cast("int") * 40)
    return m.dem.select("canonical_event_id", day.alias("mention_date"), "article_count", F.concat(F.lit("headline of "), F.date_format(day, "MMMM"), F.lit(" "), (F.dayofmonth("mention_date") % 4).cast("string")).alias("name"))


#: Stretches are far enough apart to be blocks where they have three days; here every one has.
SPLIT = """m AS (SELECT canonical_event_id, CAST(mention_date + CAST(day(mention_date) // 10 AS INT) * 40 AS DATE) AS d, article_count AS n, day(mention_date) // 10 AS s, day(mention_date) % 4 AS q FROM dem),
c AS (SELECT canonical_event_id, s, count(*) AS k, min(d) AS a, max(d) AS z FROM m GROUP BY 1, 2),
ok AS (SELECT canonical_event_id, s, k, row_number() OVER (PARTITION BY canonical_event_id ORDER BY s) AS i, count(*) OVER (PARTITION BY canonical_event_id) AS t FROM c),
h AS (SELECT canonical_event_id, s, max(i) FILTER (WHERE k >= 3 OR i = 1) OVER (PARTITION BY canonical_event_id ORDER BY s) AS b, k, i FROM ok),
f AS (SELECT canonical_event_id, s, b FROM h),
fk AS (SELECT f.canonical_event_id, f.b, sum(ok.k) AS k, min(f.s) AS s0 FROM f JOIN ok ON ok.canonical_event_id = f.canonical_event_id AND ok.s = f.s GROUP BY 1, 2),
fm AS (SELECT *, row_number() OVER (PARTITION BY canonical_event_id ORDER BY b) AS j FROM fk),
tiny AS (SELECT canonical_event_id FROM fm WHERE j = 1 AND k < 3),
bl AS (SELECT fm.canonical_event_id, fm.b, CASE WHEN fm.canonical_event_id IN (SELECT canonical_event_id FROM tiny) THEN greatest(j - 2, 0) ELSE j - 1 END AS block FROM fm),
x AS (SELECT m.*, bl.block, concat('headline of ', strftime(m.d, '%B'), ' ', m.q) AS name FROM m JOIN f ON f.canonical_event_id = m.canonical_event_id AND f.s = m.s JOIN bl ON bl.canonical_event_id = f.canonical_event_id AND bl.b = f.b),
g AS (SELECT canonical_event_id, block, CAST(sum(n) AS BIGINT) AS articles FROM x GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY canonical_event_id ORDER BY articles DESC, block) AS r, count(*) OVER (PARTITION BY canonical_event_id) AS blocks FROM g),
de AS (SELECT canonical_event_id, block, canonical_event_id % 3 = 0 AND block = 1 AS keep, CASE WHEN canonical_event_id % 3 = 1 THEN 'the same new story' WHEN canonical_event_id % 3 = 2 THEN 'Event name <x>' END AS pn FROM w),
kk AS (SELECT w.*, de.keep, de.pn, bool_or(de.keep) OVER (PARTITION BY w.canonical_event_id) AS kept FROM w JOIN de ON de.canonical_event_id = w.canonical_event_id AND de.block = w.block WHERE blocks > 1),
b1 AS (SELECT canonical_event_id, block, name FROM (SELECT *, row_number() OVER (PARTITION BY canonical_event_id, block ORDER BY n DESC, d, name) AS r FROM x) WHERE r = 1),
nd AS (SELECT kk.canonical_event_id, kk.block, CASE WHEN kept THEN keep ELSE r = 1 END AS keeps, CASE WHEN CASE WHEN kept THEN keep ELSE r = 1 END THEN '' WHEN pn IS NULL OR contains(lower(pn), 'event name') THEN b1.name ELSE pn END AS part FROM kk JOIN b1 ON b1.canonical_event_id = kk.canonical_event_id AND b1.block = kk.block),
y AS (SELECT nd.canonical_event_id, nd.part, nd.keeps, x.d, CAST(sum(x.n) AS BIGINT) AS n FROM nd JOIN x ON x.canonical_event_id = nd.canonical_event_id AND x.block = nd.block GROUP BY 1, 2, 3, 4),
z AS (SELECT *, row_number() OVER (PARTITION BY canonical_event_id, part, keeps ORDER BY n DESC, d) AS r FROM y)
SELECT canonical_event_id, part, keeps, CAST(sum(n) AS BIGINT) AS articles, count(*) AS days, min(d) AS first_day, max(d) AS last_day, max(d) FILTER (WHERE r = 1) AS peak_day, max(n) FILTER (WHERE r = 1) AS peak_articles FROM z GROUP BY 1, 2, 3"""


@query("apply_split", SPLIT, "dem")
def apply_split(m: Model):
    """Blocks by split_by_gap; decisions keep the second block, give one name to all blocks, or a placeholder."""
    mentions = spread(m)
    blocks = S.split_by_gap(mentions)
    i = F.col("canonical_event_id")
    name = F.when(i % 3 == 1, "the same new story").when(i % 3 == 2, "Event name <x>")
    decisions = blocks.select("canonical_event_id", "block").distinct().select("*", ((i % 3 == 0) & (F.col("block") == 1)).alias("keep"), name.alias("proposed_name"))
    return K.apply_split(blocks, mentions, decisions)


#: One event's days in turn: the block, its rows and its running centroid.
DRIFT = """RECURSIVE u AS (SELECT vec_id % 20 AS canonical_event_id, CAST(day + CAST(vec_id // 20 AS INT) AS DATE) AS d, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-9)) AS u FROM vectors),
o AS (SELECT *, row_number() OVER (PARTITION BY canonical_event_id ORDER BY d) AS i FROM u),
wk AS (SELECT canonical_event_id, d, i, 0 AS b, 1 AS n, u AS c FROM o WHERE i = 1
UNION ALL SELECT canonical_event_id, d, i, b, n, CASE WHEN n = 1 THEN u ELSE list_transform(c, lambda x: x / greatest(sqrt(list_inner_product(c, c)), 1e-9)) END
FROM (SELECT canonical_event_id, d, i, u, CASE WHEN new THEN b + 1 ELSE b END AS b, CASE WHEN new THEN 1 ELSE n + 1 END AS n, list_transform(list_zip(c, u), lambda x: (x[1] * n + x[2]) / (n + 1)) AS c
FROM (SELECT o.*, wk.b, wk.n, wk.c, o.d - wk.d >= 30 OR wk.n >= 3 AND list_inner_product(o.u, wk.c) < -0.2 AS new FROM wk JOIN o ON o.canonical_event_id = wk.canonical_event_id AND o.i = wk.i + 1))),
v AS (SELECT canonical_event_id, d, b FROM wk), """ + BLOCKS


@query("split_by_drift", DRIFT, "vectors")
def split_by_drift(m: Model):
    rows = m.vectors.select((F.col("vec_id") % 20).alias("canonical_event_id"), F.date_add("day", (F.col("vec_id") / 20).cast("int")).alias("mention_date"), "embedding")
    return S.split_by_drift(rows, "embedding", -0.2)


# ---- vectors: clusters and masters, by components that SQL finds by recursion
_COS = "round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6)"
_REACH = """s AS (SELECT a, b FROM q UNION SELECT b, a FROM q), r AS (SELECT vec_id AS node, vec_id AS m
  FROM vectors UNION SELECT s.a, r.m FROM r JOIN s ON s.b = r.node),
comp AS (SELECT node, min(m) AS c FROM r GROUP BY 1)"""


def _pairs(keys: str, least: float, source: str = "vectors") -> str:
    return f"q AS (SELECT x.vec_id AS a, y.vec_id AS b FROM {source} x JOIN {source} y ON {keys} AND x.vec_id < y.vec_id WHERE {_COS} >= {least})"


#: The member nearest to the mean of its cluster.
_CENTRE = """e AS (SELECT v.*, comp.c AS cluster FROM vectors v JOIN comp ON comp.node = v.vec_id), u AS (SELECT cluster, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM e),
mu AS (SELECT cluster, i, avg(CAST(x AS DOUBLE)) AS mean FROM u GROUP BY 1, 2), dd AS (SELECT u.cluster, u.vec_id, round(sum((x - mean) * (x - mean)), 9) AS d FROM u JOIN mu ON mu.cluster = u.cluster AND mu.i = u.i GROUP BY 1, 2)
SELECT cluster, count(*) AS n, arg_min(vec_id, {'d': d, 'v': vec_id}) AS representative FROM dd GROUP BY 1"""


@query("cluster_daily_events", f"RECURSIVE {_pairs('x.country = y.country AND x.day = y.day', 0.2)}, {_REACH}, {_CENTRE}", "vectors")
def cluster_daily_events(m: Model):
    return G.cluster_centroids(G.cluster_by_cosine(m.vectors, ["country", "day"], 0.2), m.vectors).select("cluster", "n", "representative")


@query("cluster_daily_entities", f"RECURSIVE {_pairs('x.country = y.country AND x.label % 3 = y.label % 3', 0.3)}, {_REACH}, {_CENTRE}", "vectors")
def cluster_daily_entities(m: Model):
    return G.cluster_centroids(G.cluster_by_cosine(m.vectors.withColumn("kind", F.col("label") % 3), ["country", "kind"], 0.3), m.vectors).select("cluster", "n", "representative")


@query("consolidate_entities", f"RECURSIVE {_pairs('x.country = y.country AND x.label % 2 = y.label % 2', 0.3)}, {_REACH}, l AS (SELECT c, arg_min(node, {{'n': -(node * 7919 % 101), 'v': node}}) AS master FROM comp GROUP BY 1) SELECT comp.node AS vec_id, l.master FROM comp JOIN l ON l.c = comp.c", "vectors")
def consolidate_entities(m: Model):
    e = m.vectors.withColumn("kind", F.col("label") % 2).withColumn("n_docs", F.col("vec_id") * 7919 % 101)
    return G.consolidate_entities(e, ["country", "kind"], 0.3)


LAYERED = f"""RECURSIVE mo AS (SELECT *, date_trunc('month', day) AS mo FROM vectors),
ed AS (SELECT *, CAST(mo + INTERVAL 1 MONTH AS DATE) AS cut FROM mo WHERE CAST(mo + INTERVAL 1 MONTH AS DATE) - day <= 7 UNION ALL SELECT *, CAST(mo AS DATE) FROM mo WHERE day - CAST(mo AS DATE) < 7),
q AS (SELECT x.vec_id AS a, y.vec_id AS b FROM mo x JOIN mo y ON x.country = y.country AND x.mo = y.mo AND x.vec_id < y.vec_id WHERE {_COS} >= 0.3
  UNION SELECT x.vec_id, y.vec_id FROM ed x JOIN ed y ON x.country = y.country AND x.cut = y.cut AND x.vec_id < y.vec_id WHERE {_COS} >= 0.3), {_REACH},
l AS (SELECT c, arg_min(node, {{'v': node % 4 <> 0, 'n': -(node * 7919 % 101), 'i': node}}) AS master FROM comp GROUP BY 1) SELECT comp.node AS vec_id, l.master FROM comp JOIN l ON l.c = comp.c"""


@query("consolidate_layered", LAYERED, "vectors")
def consolidate_layered(m: Model):
    v = m.vectors.withColumns({"validated": F.col("vec_id") % 4 == 0, "articles": F.col("vec_id") * 7919 % 101})
    return K.consolidate_layered(v, 0.3)


def composite(m: Model):
    docs = m.event_docs.groupBy(F.col("canonical_event_id").alias("id")).agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    vectors = m.vectors.select(F.col("vec_id").alias("id"), "embedding", F.date_add("day", (F.col("vec_id") % 3 * 12).cast("int")).alias("day"))
    return m.ce.select("id", F.col("initiating_country").alias("block"), F.col("total_articles").alias("articles"), F.col("total_mention_days").alias("days")).join(docs, "id").join(vectors, "id")


DISTANCE = f"""ed AS (SELECT DISTINCT canonical_event_id AS id, doc_id FROM dem_docs), n AS (SELECT id, count(*) AS n FROM ed GROUP BY 1), sh AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM ed x JOIN ed y ON x.doc_id = y.doc_id AND x.id < y.id GROUP BY 1, 2),
v AS (SELECT ce.id, ce.initiating_country, ce.total_articles AS articles, ce.total_mention_days AS days, e.embedding, CAST(e.day + CAST(e.vec_id % 3 * 12 AS INT) AS DATE) AS day, n.n FROM ce JOIN vectors e ON e.vec_id = ce.id JOIN n ON n.id = ce.id),
pd AS (SELECT x.id AS a, y.id AS b, abs(x.day - y.day) AS gap, 0.4 * (1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) + 0.2 * (1 - coalesce(sh.i, 0) / CAST(x.n + y.n - coalesce(sh.i, 0) AS DOUBLE)) AS d
  FROM v x JOIN v y ON x.initiating_country = y.initiating_country AND x.id < y.id LEFT JOIN sh ON sh.a = x.id AND sh.b = y.id),
dist AS (SELECT a, b, round(CASE WHEN gap > 30 THEN 1.0::DOUBLE ELSE d + 0.4 * least(gap / 30.0::DOUBLE, 1.0::DOUBLE) END, 6) AS distance FROM pd)"""


@query("pairwise_composite_distance", DISTANCE + " SELECT * FROM dist", "ce", "vectors")
def pairwise_composite_distance(m: Model):
    return G.pairwise_composite_distance(composite(m))


@query("consolidate_events_linked", f"RECURSIVE {DISTANCE}, s AS (SELECT a, b FROM dist WHERE distance < 0.55 UNION SELECT b, a FROM dist WHERE distance < 0.55), r AS (SELECT id AS node, id AS m FROM v UNION SELECT s.a, r.m FROM r JOIN s ON s.b = r.node), comp AS (SELECT node, min(m) AS c FROM r GROUP BY 1), l AS (SELECT c, arg_min(v.id, {{'a': -articles, 'd': -days, 'i': v.id}}) AS master FROM comp JOIN v ON v.id = comp.node GROUP BY 1) SELECT comp.node AS id, l.master FROM comp JOIN l ON l.c = comp.c", "ce", "vectors")
def consolidate_events_linked(m: Model):
    """Plain components. Only pairs within thirty days can be under the cut, so only these are made."""
    e, _ = written(composite(m), "composite")
    return G.consolidate(G.composite_links(e, 0.55), e.select("id", "articles", "days"), 0.55)


@query("consolidate_events")
def consolidate_events(m: Model):
    """Density clusters of the events of each country within thirty days of each other."""
    e, _ = written(composite(m), "composite")
    nodes = e.select("id", "day", "articles", "days")
    return D.consolidate_by_density(G.composite_links(e, 1.0), nodes)


# ---- entities and their graph
def entity_docs(m: Model):
    """Entities with the countries of their documents."""
    return m.den.join(m.ic.where(F.col("initiating_country").isin(*m.scope.influencers)), "doc_id").select("initiating_country", "entity", "doc_id").distinct()


CO = """e AS (SELECT DISTINCT ic.initiating_country, den.entity, den.doc_id FROM den JOIN ic ON ic.doc_id = den.doc_id WHERE ic.initiating_country IN {INF}),
pr AS (SELECT x.initiating_country, x.entity AS a, y.entity AS b, x.doc_id, row_number() OVER (PARTITION BY x.initiating_country, x.entity, y.entity ORDER BY x.doc_id) AS r, count(*) OVER (PARTITION BY x.initiating_country, x.entity, y.entity) AS weight FROM e x JOIN e y ON x.initiating_country = y.initiating_country AND x.doc_id = y.doc_id AND x.entity < y.entity),
sh AS (SELECT * FROM pr WHERE weight >= 2 AND r <= 100),
g AS (SELECT initiating_country, a, b, max(weight) AS weight, min(d.date) AS first_day, max(d.date) AS last_day, count(*) AS shown FROM sh JOIN d ON d.doc_id = sh.doc_id GROUP BY 1, 2, 3)"""


def edges(m: Model):
    return G.entity_cooccurrence(entity_docs(m), m.d, m.cat)


def one_graph(m: Model):
    """Edges over all countries: weights added up."""
    return edges(m).groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("last_day").alias("last_day"))


GU = ("den", "d", "cat")
ONE = CO + ", og AS (SELECT a, b, CAST(sum(weight) AS BIGINT) AS weight, max(last_day) AS last_day FROM g GROUP BY 1, 2)"


@query("entity_cooccurrence", CO + """, lab AS (SELECT sh.initiating_country, a, b, count(*) AS labels, count(DISTINCT category) AS categories
  FROM sh JOIN cat ON cat.doc_id = sh.doc_id GROUP BY 1, 2, 3) SELECT g.*, lab.labels, lab.categories
FROM g LEFT JOIN lab ON lab.initiating_country = g.initiating_country AND lab.a = g.a AND lab.b = g.b""", *GU)
def entity_cooccurrence(m: Model):
    total = F.aggregate(F.map_values("categories"), F.lit(0).cast("long"), lambda a, x: a + x)
    e = edges(m).withColumns({"labels": total, "n": F.size(F.map_keys("categories")).cast("long"), "shown": F.size("doc_ids").cast("long")})
    return e.select("initiating_country", "a", "b", "weight", "first_day", "last_day", "shown", F.when(F.col("categories").isNotNull(), F.col("labels")).alias("labels"), F.when(F.col("categories").isNotNull(), F.col("n")).alias("categories"))


@query("graph_degree", ONE + """, s AS (SELECT a AS node, weight FROM og UNION ALL SELECT b, weight
  FROM og) SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted
FROM s GROUP BY 1""", *GU)
def graph_degree(m: Model):
    return G.graph_degree(one_graph(m))


@query("entity_neighbors", ONE + """, bo AS (SELECT a, b, weight FROM og WHERE weight >= 3 UNION ALL SELECT b, a, weight FROM og WHERE weight >= 3),
h1 AS (SELECT DISTINCT b AS node FROM (SELECT * FROM bo WHERE a = 'click_1' ORDER BY weight DESC, a, b LIMIT 8) WHERE b <> 'click_1'),
h2 AS (SELECT DISTINCT b AS node FROM (SELECT * FROM bo WHERE a IN (SELECT node FROM h1) ORDER BY weight DESC, a, b LIMIT 8) WHERE b <> 'click_1' AND b NOT IN (SELECT node FROM h1)),
h3 AS (SELECT DISTINCT b AS node FROM (SELECT * FROM bo WHERE a IN (SELECT node FROM h2) ORDER BY weight DESC, a, b LIMIT 8) WHERE b <> 'click_1' AND b NOT IN (SELECT node FROM h1) AND b NOT IN (SELECT node FROM h2))
SELECT 'click_1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3""", *GU)  # fmt: skip
def entity_neighbors(m: Model):
    """Neighbours ask for weights only."""
    weights = G.entity_weights(entity_docs(m)).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    return G.entity_neighbors(weights, "click_1", 3, strongest=8, least=3)


#: A shortest path of two nodes is a shortest walk, so numbers of walks by length give distances and numbers of paths.
BETWEEN = "RECURSIVE " + CO + """, ge AS (SELECT initiating_country AS actor, a, b FROM g WHERE weight >= 3), dg AS (SELECT actor, n, count(*) AS k FROM (SELECT actor, a AS n FROM ge UNION ALL SELECT actor, b FROM ge) GROUP BY 1, 2),
tn AS (SELECT actor, n FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY k DESC, n) AS r FROM dg) WHERE r <= 40),
ie AS (SELECT ge.* FROM ge JOIN tn x ON x.actor = ge.actor AND x.n = ge.a JOIN tn y ON y.actor = ge.actor AND y.n = ge.b), ad AS MATERIALIZED (SELECT actor, a, b FROM ie UNION SELECT actor, b, a FROM ie), nd AS (SELECT DISTINCT actor, a AS n FROM ad),
wk AS (SELECT actor, n AS s, n AS t, 0 AS l, 1.0::DOUBLE AS c FROM nd UNION ALL SELECT wk.actor, wk.s, ad.b, wk.l + 1, sum(wk.c) FROM wk JOIN ad ON ad.actor = wk.actor AND ad.a = wk.t WHERE wk.l < 39 GROUP BY wk.actor, wk.s, ad.b, wk.l),
pt AS (SELECT actor, s, t, min(l) AS l, arg_min(c, l) AS c FROM wk GROUP BY 1, 2, 3),
bt AS (SELECT x.actor, x.t AS n, sum(x.c * y.c / z.c) / 2 AS v FROM pt x JOIN pt y ON y.actor = x.actor AND y.s = x.t JOIN pt z ON z.actor = x.actor AND z.s = x.s AND z.t = y.t AND z.l = x.l + y.l WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t GROUP BY 1, 2)
SELECT nd.actor, nd.n AS node, round(coalesce(bt.v, 0.0), 6) AS betweenness FROM nd LEFT JOIN bt ON bt.actor = nd.actor AND bt.n = nd.n"""


@query("ego_subgraph_betweenness", BETWEEN, *GU)
def ego_subgraph_betweenness(m: Model):
    return G.ego_subgraph_betweenness(edges(m).where("weight >= 3").withColumnRenamed("initiating_country", "actor"), "actor")


@query("entity_profile", ONE + """, me AS (SELECT 'click_1' AS entity), ev AS (SELECT DISTINCT f.master, ce.last_mention_date AS last_day FROM den JOIN fdocs f ON f.doc_id = den.doc_id JOIN ce ON ce.id = f.master WHERE den.entity = 'click_1')
SELECT 'profile' AS section, 'documents' AS key, total_documents AS n, last_mention_date AS day FROM cen WHERE entity = 'click_1'
UNION ALL SELECT * FROM (SELECT 'outgoing', b, weight, last_day FROM og WHERE a = 'click_1' ORDER BY weight DESC, b LIMIT 20) UNION ALL SELECT * FROM (SELECT 'incoming', a, weight, last_day FROM og WHERE b = 'click_1' ORDER BY weight DESC, a LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'event', CAST(master AS VARCHAR), NULL, last_day FROM ev ORDER BY last_day DESC, master LIMIT 20)
UNION ALL SELECT 'month', strftime(mention_date, '%Y-%m'), count(*), NULL FROM (SELECT DISTINCT mention_date, doc_id FROM den WHERE entity = 'click_1') GROUP BY 2""", *GU, "cen", "fdocs")  # fmt: skip
def entity_profile(m: Model):
    events = G.link_entities_to_events(m.den.where("entity = 'click_1'"), E.family_docs(m.ce, m.event_docs)).join(m.ce.select(F.col("id").alias("master"), F.col("last_mention_date").alias("last_day")), "master")
    return B.entity_profile("click_1", m.cen, one_graph(m), m.den, events)


MERGED = """ma AS (SELECT entity, first(entity ORDER BY total_documents DESC, entity) OVER (PARTITION BY entity_type) AS master FROM cen),
x AS (SELECT den.*, ma.master FROM den JOIN ma ON ma.entity = den.entity), dd AS (SELECT DISTINCT master, doc_id FROM x),
ev AS (SELECT DISTINCT ma.master, f.master AS event FROM den JOIN ma ON ma.entity = den.entity JOIN fdocs f ON f.doc_id = den.doc_id),
a AS (SELECT master, count(DISTINCT entity) AS entities, count(DISTINCT doc_id) AS n_docs, count(DISTINCT mention_date) AS mention_days, min(mention_date) AS first_day, max(mention_date) AS last_day, string_agg(DISTINCT entity, ',' ORDER BY entity) FILTER (WHERE entity <> master) AS alternative_names FROM x GROUP BY 1),
e AS (SELECT master, count(*) AS events, CAST(sum(event) AS BIGINT) AS event_ids FROM ev GROUP BY 1),
c AS (SELECT master, string_agg(concat(category, ':', n), ',' ORDER BY category) AS categories FROM (SELECT master, category, count(*) AS n FROM dd JOIN cat ON cat.doc_id = dd.doc_id GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT master, string_agg(concat(recipient_country, ':', n), ',' ORDER BY recipient_country) AS recipients FROM (SELECT master, recipient_country, count(*) AS n FROM dd JOIN rc ON rc.doc_id = dd.doc_id GROUP BY 1, 2) GROUP BY 1)
SELECT a.*, e.events, e.event_ids, c.categories, r.recipients FROM a LEFT JOIN e ON e.master = a.master LEFT JOIN c ON c.master = a.master LEFT JOIN r ON r.master = a.master"""


@query("merge_canonical_entities", MERGED, "cen", "fdocs", "cat", "rc")
def merge_canonical_entities(m: Model):
    """The entity of a type with most documents takes over the others."""
    lead = m.cen.groupBy("entity_type").agg(F.min(F.struct((-F.col("total_documents")).alias("n"), "entity")).alias("b")).select("entity_type", F.col("b.entity").alias("master"))
    masters = m.cen.select("entity", "entity_type").join(lead, "entity_type").select("entity", "master")
    events = G.link_entities_to_events(m.den, E.family_docs(m.ce, m.event_docs)).withColumnRenamed("master", "master_event")
    g = G.merge_canonical_entities(m.den, masters, m.rc, m.cat, events)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(c)
    names = F.when(F.size("alternative_names") > 0, F.array_join("alternative_names", ",")).alias("alternative_names")
    total = F.aggregate("events", F.lit(0).cast("long"), lambda a, x: a + x)
    return g.select("master", "entities", "n_docs", "mention_days", "first_day", "last_day", names, F.size("events").cast("long").alias("events"), total.alias("event_ids"), text("categories"), text("recipients"))


# ---- names
GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr(concat('  ', w, ' '), CAST(i AS INT), 3)))))"


def grams(c: str) -> str:
    return GRAMS.replace("{c}", c).replace("{{", "{").replace("}}", "}")


def shared_grams(x: str, y: str) -> str:
    i = f"len(list_intersect({x}, {y}))"
    return f"coalesce({i} / nullif(CAST(len({x}) + len({y}) - {i} AS DOUBLE), 0), 0.0)"


@query("trigram_similarity", f"g AS (SELECT p_partkey, {grams('p_name')} AS a, {grams("concat(p_brand, ' ', p_name)")} AS b FROM part) SELECT p_partkey, round({shared_grams('a', 'b')}, 6) AS similarity FROM g")
def trigram_similarity(m: Model):
    return m.table("part").select("p_partkey", F.round(C.trigram_similarity(F.col("p_name"), F.concat("p_brand", F.lit(" "), "p_name")), 6).alias("similarity"))


@query("similar_name_pairs", f"n AS (SELECT DISTINCT name, {grams('name')} AS g FROM (SELECT title AS name FROM d UNION SELECT p_name FROM part UNION SELECT p_type FROM part)), p AS (SELECT x.name AS a, y.name AS b, {shared_grams('x.g', 'y.g')} AS s FROM n x JOIN n y ON x.name < y.name) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s > 0.6 OR contains(a, b) OR contains(b, a)", "d")
def similar_name_pairs(m: Model):
    p = m.table("part")
    return M.similar_name_pairs(m.d.select(F.col("title").alias("name")).union(p.select("p_name")).union(p.select("p_type")).distinct())


#: Names in turn, with the list of those that stayed.
GREEDY = """RECURSIVE n AS (SELECT title AS name, min(doc_id) AS rank FROM d GROUP BY 1), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rank, name) AS i FROM n),
nb AS MATERIALIZED (SELECT y.i, list(x.i) AS better FROM o x JOIN o y ON x.i < y.i AND 1 - levenshtein(lower(x.name), lower(y.name)) / greatest(length(x.name), length(y.name), 1)::DOUBLE > 0.85 GROUP BY 1),
wk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(wk.kept, coalesce(nb.better, [])) THEN wk.kept ELSE list_append(wk.kept, o.i) END FROM wk JOIN o ON o.i = wk.i + 1 LEFT JOIN nb ON nb.i = o.i),
last AS (SELECT unnest(kept) AS i FROM (SELECT kept FROM wk ORDER BY i DESC LIMIT 1)) SELECT o.name, o.rank FROM o JOIN last ON last.i = o.i"""


@query("dedupe_fuzzy_names", GREEDY, "d")
def dedupe_fuzzy_names(m: Model):
    return M.dedupe_fuzzy_names(m.d.groupBy(F.col("title").alias("name")).agg(F.min("doc_id").alias("rank")), 0.85)


MATCH = f"""e AS (SELECT entity, {grams('entity')} AS g FROM cen), qs AS (SELECT b.vec_id AS query_id, b.embedding AS q, CASE b.vec_id % 4 WHEN 0 THEN 'CLICK_1' WHEN 1 THEN 'views 3' WHEN 2 THEN 'purchase 12' ELSE 'k_2' END AS name FROM embeddings b WHERE b.vec_id % 100 = 0),
qq AS (SELECT query_id, concat(name, ' of ', query_id) AS long, name, q FROM qs), qn AS (SELECT query_id, CASE WHEN query_id % 200 = 0 THEN name ELSE long END AS query, q FROM qq), qg AS (SELECT *, {grams('query')} AS g FROM qn),
ev AS (SELECT cen.entity, v.embedding FROM (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS k FROM cen) cen JOIN embeddings v ON v.vec_id = cen.k),
c AS (SELECT query, entity, CASE WHEN contains(lower(entity), lower(query)) THEN 1 WHEN {shared_grams('qg.g', 'e.g')} >= 0.4 THEN 2 END AS tier, CASE WHEN contains(lower(entity), lower(query)) THEN 1.0::DOUBLE ELSE round({shared_grams('qg.g', 'e.g')}, 6) END AS score FROM qg, e),
nn AS (SELECT query_id, entity, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM qg, ev), nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS r FROM nn),
al AS (SELECT query, entity, tier, score FROM c WHERE tier IS NOT NULL UNION ALL SELECT qn.query, nr.entity, 3, nr.score FROM nr JOIN qn ON qn.query_id = nr.query_id WHERE r <= 200 AND score >= 0.1),
be AS (SELECT *, row_number() OVER (PARTITION BY query, entity ORDER BY tier, score DESC) AS r FROM al), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, entity) AS k FROM be WHERE r = 1)
SELECT query, entity, tier, score FROM o WHERE k <= 5"""


@query("match_entities", MATCH, "cen")
def match_entities(m: Model):
    """Queries by hand for every hundredth vector; entities in order of name have the vectors in order."""
    i = F.col("vec_id")
    name = F.when(i % 4 == 0, "CLICK_1").when(i % 4 == 1, "views 3").when(i % 4 == 2, "purchase 12").otherwise("k_2")
    queries = m.vectors.where("vec_id % 100 = 0").select(i.alias("query_id"), F.when(i % 200 == 0, name).otherwise(F.concat(name, F.lit(" of "), i.cast("string"))).alias("query"), F.col("embedding").alias("q"))
    # places in order of name: those in each range of names, after all of the ranges before
    names, _ = written(m.cen.select("entity").repartitionByRange("entity").select("entity", F.spark_partition_id().alias("range")), "names")
    before = names.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))  # a row a range
    place = names.join(before, "range").select("entity", (F.col("before") + F.row_number().over(W.partitionBy("range").orderBy("entity")) - 1).alias("vec_id"))
    return M.match_entities(queries, m.cen.select("entity")
    .join(place, "entity")
    .join(m.vectors.select("vec_id", "embedding"), "vec_id", "left")
    .select("vec_id", "entity", "embedding"), 5, similar=0.4, near=0.1)


# ---- themes
STOP = ["2024", "2025", "2026", "new", "meeting", "visit", "agreement", "signing", "announcement", "international", "summit", "part"]


def theme_recipients(m: Model):
    """Distinct (vec_id, recipient): who is told of in documents with the name of a vector's part."""
    # few names and recipients: their pairs are made before parts come in, of which a name has many
    parts = m.table("part").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("event_name"))
    told = m.table("lineitem").join(parts.withColumnRenamed("vec_id", "l_partkey"), "l_partkey").select(F.col("l_orderkey").alias("doc_id"), "event_name")
    pairs, _ = written(told.join(m.rc, "doc_id").select("event_name", F.col("recipient_country").alias("recipient")).distinct(), "named-recipients")
    return parts.join(m.vectors.select("vec_id"), "vec_id", "left_semi").join(pairs, "event_name").select("vec_id", "recipient").distinct()


def theme_table(m: Model):
    events = m.table("part").select(F.col("p_partkey").alias("vec_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), (F.col("p_partkey") % 9).alias("score")).join(m.vectors.select("vec_id", F.col("country").alias("actor"), "day"), "vec_id")
    themes, _ = written(K.narrative_themes(m.vectors), "themes")  # asked once for each figure
    return K.theme_summary(themes, events, theme_recipients(m), STOP)


@query("theme_summary")
def theme_summary(m: Model):
    return theme_table(m)


@query("coherent_campaigns")
def coherent_campaigns(m: Model):
    return K.coherent_campaigns(theme_table(m))


# ---- series
GEO = """pt AS (SELECT doc_id, initiating_country, self_reported, recipient_country AS location, concat(CAST(CAST((doc_id % 1800) / 10.0::DOUBLE - 90 AS DECIMAL(8,2)) AS VARCHAR), ',', CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE CAST(CAST((doc_id % 1100) / 10.0::DOUBLE AS DECIMAL(8,2)) AS VARCHAR) END) AS ll FROM rb),
ok AS (SELECT DISTINCT doc_id, initiating_country, self_reported, location, CAST(round(CAST(split_part(ll, ',', 1) AS DECIMAL(18,8)) * 4, 0) / 4 AS DOUBLE) AS lat, CAST(round(CAST(split_part(ll, ',', 2) AS DECIMAL(18,8)) * 4, 0) / 4 AS DOUBLE) AS long FROM pt WHERE regexp_matches(ll, '^-?[0-9]+([.][0-9]+)?,[ ]*-?[0-9]+([.][0-9]+)?$')),
k AS (SELECT initiating_country, lat, long, location, row_number() OVER (PARTITION BY initiating_country, lat, long ORDER BY count(*) DESC, location) AS r FROM ok GROUP BY 1, 2, 3, 4)
SELECT ok.initiating_country, ok.lat, ok.long, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) FILTER (WHERE NOT self_reported) AS third_docs, any_value(k.location) AS place FROM ok JOIN k ON k.initiating_country = ok.initiating_country AND k.lat = ok.lat AND k.long = ok.long AND k.r = 1 WHERE ok.lat BETWEEN -60 AND 75 AND ok.long BETWEEN -180 AND 180 GROUP BY 1, 2, 3"""


@query("geo_intensity", GEO, "rb")
def geo_intensity(m: Model):
    """Latitudes from pole to pole, a thirteenth of them without a longitude."""
    i = F.col("doc_id")
    text = lambda x: x.cast("decimal(8,2)").cast("string")
    point = F.concat(text((i % 1800) / 10.0 - 90), F.lit(","), F.when(i % 13 == 0, "x").otherwise(text((i % 1100) / 10.0)))
    return P.geo_intensity(base(m).select("doc_id", "initiating_country", "self_reported", point.alias("lat_long"), F.col("recipient_country").alias("location")))


@query("month_gaps", MON + """, sm AS (SELECT DISTINCT month FROM rb WHERE initiating_country = 'NATION_1' AND recipient_country = 'NATION_7' AND category = 'SMALL')
SELECT month FROM sp WHERE month NOT IN (SELECT month FROM sm)""", "pi")
def month_gaps(m: Model):
    return S.month_gaps(base(m).where("initiating_country = 'NATION_1' AND recipient_country = 'NATION_7' AND category = 'SMALL'"), "1996-01-01", "2000-12-01")


SCAN = """, t AS (SELECT *, count(*) OVER l AS n1, avg(y) OVER l AS m1, var_pop(y) OVER l * count(*) OVER l AS v1, count(*) OVER g AS n2, avg(y) OVER g AS m2, var_pop(y) OVER g * count(*) OVER g AS v2 FROM zf
WINDOW l AS (PARTITION BY initiating_country ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY initiating_country ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, sqrt((v1 + v2) / greatest(n1 + n2 - 2, 1)) AS sp FROM t WHERE n1 >= 3 AND n2 >= 3), z AS (SELECT *, round(abs(m1 - m2) / (sp * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 6) AS z FROM u WHERE sp > 1e-9),
b AS (SELECT *, row_number() OVER (PARTITION BY initiating_country ORDER BY z DESC, month) AS r FROM z) SELECT initiating_country, month AS cp_month, z, round(m1, 6) AS pre_mean, round(m2, 6) AS post_mean FROM b WHERE r = 1"""


@query("changepoint_scan", MON + SCAN, "pi")
def changepoint_scan(m: Model):
    return S.changepoint_scan(monthly(m), ["initiating_country"])


@query("binseg", MON + ", " + segmented("initiating_country", "zf", 0).replace("CASE WHEN post > pre THEN 'surge' ELSE 'decline' END AS direction, CASE WHEN pre > 0 THEN round(post / pre, 2) END AS magnitude, ", ""), "pi")
def binseg(m: Model):
    """Changepoints by the table function, joined laterally in SQL."""
    S.binseg_udtf(m.spark)
    s = monthly(m).groupBy("initiating_country").agg(F.sort_array(F.collect_list(F.struct("month", "y"))).alias("s"))
    s = s.select("initiating_country", F.transform("s", lambda x: x["month"]).alias("months"), F.transform("s", lambda x: x["y"]).alias("ys"))
    return m.spark.sql("SELECT s.initiating_country, c.* FROM {s} s, LATERAL binseg(s.months, s.ys) c", s=s)


def _span(a: str, b: str, p: str) -> str:
    return f"(SELECT count(DISTINCT doc_id) AS {p}n_docs, count(DISTINCT x.canonical_event_id) AS {p}n_events, count(*) AS {p}n_articles, avg(CAST(material_score AS DOUBLE)) AS {p}mean_score FROM dem_docs x JOIN ce ON ce.id = x.canonical_event_id WHERE mention_date BETWEEN DATE '{a}' AND DATE '{b}')"


_CH = {c: f"(c.n_{c} - p.p_n_{c}) / greatest(CAST(p.p_n_{c} AS DOUBLE), 1.0)" for c in ("docs", "events", "articles")}
_VOTE = "CASE WHEN {x} >= {b} THEN 2 WHEN {x} >= {a} THEN 1 WHEN {x} <= -{b} THEN -2 WHEN {x} <= -{a} THEN -1 ELSE 0 END"


def _vote(x: str, a: float, b: float) -> str:
    return _VOTE.replace("{x}", f"({x})").replace("{a}", str(a)).replace("{b}", str(b))


TRAJECTORY = f"""t AS (SELECT {', '.join(f'round({x}, 6) AS {c}_delta' for c, x in _CH.items())}, round(mean_score - p_mean_score, 6) AS score_delta, p_n_docs, {' + '.join(_vote(x, 0.2, 0.5) for x in _CH.values())}
+ CASE WHEN mean_score IS NULL AND p_mean_score IS NULL THEN 0 WHEN mean_score IS NULL THEN -1 WHEN p_mean_score IS NULL THEN 1 ELSE {_vote('mean_score - p_mean_score', 0.5, 1.5)} END AS v,
{' + '.join(f'CAST(n_{c} > 0 OR p_n_{c} > 0 AS INT)' for c in _CH)} + CAST(mean_score IS NOT NULL OR p_mean_score IS NOT NULL AS INT) AS k FROM {_span('2024-01-21', '2024-01-30', '')} c, {_span('2024-01-08', '2024-01-14', 'p_')} p)
SELECT docs_delta, events_delta, articles_delta, score_delta, CAST(CASE WHEN p_n_docs < 5 THEN 0 ELSE v END AS INT) AS votes, CASE WHEN p_n_docs < 5 THEN 'steady' WHEN v >= 2 THEN 'accelerating' WHEN v <= -2 THEN 'cooling' ELSE 'steady' END AS trajectory,
CASE WHEN p_n_docs < 5 THEN 'LOW' WHEN k >= 3 AND abs(v) >= 5 THEN 'HIGH' WHEN k >= 2 AND abs(v) >= 2 THEN 'MED' ELSE 'LOW' END AS confidence FROM t"""


@query("trajectory", TRAJECTORY, "ce")
def trajectory(m: Model):
    """Ten days against a week before."""

    def span(a: str, b: str):
        d = m.event_docs.where(f"mention_date BETWEEN DATE'{a}' AND DATE'{b}'").join(m.ce.select(F.col("id").alias("canonical_event_id"), "material_score"), "canonical_event_id")
        return d.agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("canonical_event_id").alias("n_events"), F.count("*").alias("n_articles"), F.avg(F.col("material_score").cast("double")).alias("mean_score"))

    return S.trajectory(span("2024-01-21", "2024-01-30"), span("2024-01-08", "2024-01-14"))


SUFFICIENT = """g AS (SELECT initiating_country, recipient_country, count(DISTINCT doc_id) AS n FROM rb GROUP BY 1, 2), e AS (SELECT ce.initiating_country, r.key AS recipient_country, count(*) AS e FROM ce JOIN rcounts r ON r.id = ce.id WHERE master_event_id IS NULL AND ce.id % 4 <> 0 GROUP BY 1, 2)
SELECT g.initiating_country, g.recipient_country, n AS n_docs, coalesce(e, 0) AS n_events, n >= 20 AS enough_docs, coalesce(e, 0) >= 3 AS enough_events, CASE WHEN n >= 200 AND coalesce(e, 0) >= 10 THEN 'HIGH' WHEN n >= 50 AND coalesce(e, 0) >= 5 THEN 'MEDIUM' WHEN n >= 20 AND coalesce(e, 0) >= 3 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence
FROM g LEFT JOIN e ON e.initiating_country = g.initiating_country AND e.recipient_country = g.recipient_country"""


@query("data_sufficiency", SUFFICIENT, "rb", "ce", "rcounts")
def data_sufficiency(m: Model):
    key = ["initiating_country", "recipient_country"]
    e = E.masters(m.ce).where("id % 4 <> 0").join(m.recipient_counts, "id").groupBy("initiating_country", F.col("key").alias("recipient_country")).agg(F.count("*").alias("n_events"))
    j = N.count_docs(base(m), key).join(e, key, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))
    n, k = F.col("n_docs"), F.col("n_events")
    return j.select(*key, "n_docs", "n_events", (n >= 20).alias("enough_docs"), (k >= 3).alias("enough_events"), S.data_sufficiency(n, k).alias("confidence"))


# ---- retrieval
def text_docs(m: Model):
    return m.table("documents").select("doc_id", "text")


def queries_of(m: Model):
    return m.table("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.array_distinct(R.tokens(F.col("text"))), " ").alias("query")).where("query <> ''")


def bm25(docs: str | dict[str, float], asked: str, id_: str, k: int) -> str:
    """CTEs that end in `kw` (query_id, id, score, rank); docs: SQL of (id, text), or such with their weights; asked: SQL of (query_id, query)."""
    words = "unnest(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'))"
    parts = " UNION ALL ".join(f"SELECT {id_}, {words.replace('{c}', 'text')} AS term, {w}::DOUBLE AS w FROM ({sql})" for sql, w in (docs if isinstance(docs, dict) else {docs: 1.0}).items())
    return f"""tk AS ({parts}), po AS (SELECT term, {id_}, sum(w) AS tf, count(*) AS c FROM tk WHERE term <> '' GROUP BY 1, 2), dl AS (SELECT {id_}, sum(c) AS n_tokens FROM po GROUP BY 1), tt AS (SELECT count(*) AS n, avg(n_tokens) AS mean FROM dl),
aq AS (SELECT DISTINCT query_id, {words.replace('{c}', 'query')} AS term FROM ({asked})), an AS (SELECT * FROM aq WHERE term <> ''), nq AS (SELECT query_id, count(*) AS need FROM an GROUP BY 1), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
hi AS (SELECT an.query_id, po.{id_}, round(sum(ln(1 + (tt.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * po.tf * 2.2::DOUBLE / (po.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.n_tokens / tt.mean))), 6) AS score, count(*) AS matched FROM an JOIN po ON po.term = an.term JOIN df ON df.term = an.term JOIN dl ON dl.{id_} = po.{id_}, tt GROUP BY 1, 2),
kr AS (SELECT hi.query_id, hi.{id_}, score, CAST(row_number() OVER (PARTITION BY hi.query_id ORDER BY score DESC, hi.{id_}) AS INT) AS rank FROM hi JOIN nq ON nq.query_id = hi.query_id WHERE matched = need), kw AS (SELECT * FROM kr WHERE rank <= {k})"""


ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


@query("keyword_search_body", bm25("SELECT doc_id, text FROM documents", ITEMS, "doc_id", 10) + " SELECT * FROM kw")
def keyword_search_body(m: Model):
    return X.block_search(queries_of(m), text_docs(m), {"text": 1.0}, 10)


def titled(m: Model):
    """Documents with what comes before the first stop as their title."""
    return m.table("documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("body"))


@query("keyword_search", bm25({"SELECT doc_id, split_part(text, '.', 1) AS text FROM documents": 1.0, "SELECT doc_id, text FROM documents": 0.4}, ITEMS, "doc_id", 10) + " SELECT * FROM kw")
def keyword_search(m: Model):
    """All distinct words of each benchmark text; a word of the title weighs more than one of the body."""
    return X.block_search(queries_of(m), titled(m), {"title": X.TITLE, "body": X.BODY}, 10)


@query("keyword_search_words", bm25({"SELECT doc_id, split_part(text, '.', 1) AS text FROM documents": 1.0, "SELECT doc_id, text FROM documents": 0.4}, "SELECT item_id AS query_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: len(t) > 1))), 1, 2), ' ') AS query FROM benchmark", "doc_id", 10) + " SELECT * FROM kw")
def keyword_search_words(m: Model):
    """The first two words of more than one letter of each benchmark text by alphabet, which many documents have."""
    two = F.slice(F.array_sort(F.array_distinct(F.filter(R.tokens(F.col("text")), lambda t: F.length(t) > 1))), 1, 2)
    asked = m.table("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(two, " ").alias("query"))
    return X.block_search(asked, titled(m), {"title": X.TITLE, "body": X.BODY}, 10)


def part_words(m: Model):
    """The words of the part that has a vector's id."""
    return m.table("part").select(F.col("p_partkey").alias("vec_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")).join(m.vectors.select("vec_id"), "vec_id", "left_semi")


def by_vector(m: Model, k: int = 10):
    return R.vector_search(m.vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), m.vectors, k)


def by_words(m: Model, k: int = 10):
    """Parts that have all words of the query's part's type."""
    p = R.build_postings(part_words(m), "vec_id", {"text": "B"})
    asked = m.table("part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("query")).join(m.vectors.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    return R.keyword_search(asked, p, p.groupBy("vec_id").agg(F.sum("tf").alias("n_tokens")), k, "vec_id")


PARTS = "SELECT p_partkey AS vec_id, concat(p_name, ' ', p_type) AS text FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)"
ASKED = "SELECT p_partkey AS query_id, p_type AS query FROM part WHERE p_partkey % 100 = 0 AND p_partkey IN (SELECT vec_id FROM embeddings)"
VEC = """vs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), v AS (SELECT *
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
    FROM vs) WHERE rank <= {k})"""
BOTH = VEC.replace("{k}", "40") + ", " + bm25(PARTS, ASKED, "vec_id", 40)
FUSED = """ SELECT {id} round(coalesce(0.7 / (60.0::DOUBLE + v.rank), 0.0) + coalesce(0.3 / (60.0::DOUBLE + kw.rank), 0.0), 6) AS rrf_score
FROM v {how} JOIN kw ON kw.query_id = v.query_id AND kw.vec_id = v.vec_id"""
LEFT = BOTH + FUSED.replace("{id}", "v.query_id, v.vec_id,").replace("{how}", "LEFT")


@query("hybrid_search_rrf", LEFT)
def hybrid_search_rrf(m: Model):
    return R.hybrid_rrf(by_vector(m, 40), by_words(m, 40), "vec_id")


NAMED = {"SELECT p_partkey AS vec_id, p_name AS text FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)": 1.0, "SELECT p_partkey AS vec_id, p_type AS text FROM part WHERE p_partkey IN (SELECT vec_id FROM embeddings)": 0.4}


@query("hybrid_search_text", LEFT.replace(bm25(PARTS, ASKED, "vec_id", 40), bm25(NAMED, ASKED, "vec_id", 40)))
def hybrid_search_text(m: Model):
    """Keyword ranks of parts whose name weighs more than their type."""
    asked = m.table("part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("query")).join(m.vectors.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    parts = m.table("part").select(F.col("p_partkey").alias("vec_id"), "p_name", "p_type").join(m.vectors.select("vec_id"), "vec_id", "left_semi")
    return R.hybrid_rrf(by_vector(m, 40), X.block_search(asked, parts, {"p_name": X.TITLE, "p_type": X.BODY}, 40, "vec_id"), "vec_id")


@query("hybrid_search_text_full", BOTH + FUSED.replace("{id}", "coalesce(v.query_id, kw.query_id) AS query_id, coalesce(v.vec_id, kw.vec_id) AS vec_id,").replace("{how}", "FULL"))
def hybrid_search_text_full(m: Model):
    return R.hybrid_rrf(by_vector(m, 40), by_words(m, 40), "vec_id", full_outer=True)


def reranked(m: Model):
    """The vector list with the share of words that a candidate's part and the query's part have in common; null where one has no part."""
    w = part_words(m).select("vec_id", F.array_distinct(R.tokens(F.col("text"))).alias("w"))
    j = by_vector(m).join(w, "vec_id", "left").join(w.select(F.col("vec_id").alias("query_id"), F.col("w").alias("qw")), "query_id", "left")
    return j.select("query_id", "vec_id", "rank", (F.size(F.array_intersect("w", "qw")) / F.size(F.array_union("w", "qw"))).alias("rerank_score"))


RERANK = VEC.replace("{k}", "10") + f""", wd AS (SELECT vec_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS w FROM ({PARTS})),
j AS (SELECT v.query_id, v.vec_id, v.rank, len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) AS s FROM v LEFT JOIN wd a ON a.vec_id = v.vec_id LEFT JOIN wd b ON b.vec_id = v.query_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, vec_id) AS rr FROM j), fu AS (SELECT *, round(0.6 / (60.0::DOUBLE + rr) + 0.4 / (60.0::DOUBLE + rank), 9) AS fused FROM rr), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS place FROM fu),
pi AS (SELECT *, max(CASE WHEN rank = 1 AND place > 3 THEN place END) OVER (PARTITION BY query_id) AS pinned FROM pl)
SELECT query_id, vec_id, fused, CAST(CASE WHEN pinned IS NULL THEN place WHEN rank = 1 THEN 3 WHEN place >= 3 AND place < pinned THEN place + 1 ELSE place END AS INT) AS place FROM pi"""


@query("rerank_fusion", RERANK)
def rerank_fusion(m: Model):
    return R.rerank_fusion(reranked(m), "vec_id")


@query("entity_boost", VEC.replace("{k}", "10") + f", {bm25(PARTS, ASKED, 'vec_id', 50)} SELECT v.query_id, v.vec_id, round(CASE WHEN kw.vec_id IS NOT NULL THEN least(v.score + 0.15, 1.0) ELSE v.score END, 6) AS score FROM v LEFT JOIN kw ON kw.query_id = v.query_id AND kw.vec_id = v.vec_id")
def entity_boost(m: Model):
    """The parts that match a query's words, fifty at most, are its matched entities' documents."""
    return R.entity_boost(by_vector(m), by_words(m, 50).select("query_id", "vec_id"), "vec_id")


RANKING = VEC.replace("{k}", "10") + """, re AS (SELECT q.vec_id AS query_id, v.vec_id FROM embeddings q JOIN embeddings v ON v.label = q.label WHERE q.vec_id % 100 = 0), n AS (SELECT query_id, count(*) AS n FROM re GROUP BY 1),
h AS (SELECT v.query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM v JOIN re ON re.query_id = v.query_id AND re.vec_id = v.vec_id GROUP BY 1), g AS (SELECT query_id, n, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n, 10)) AS ideal FROM n)
SELECT g.query_id, round(coalesce(hits, 0) / CAST(g.n AS DOUBLE), 6) AS recall, coalesce(hits > 0, false) AS hit, round(coalesce(1.0::DOUBLE / first, 0.0), 6) AS rr, round(coalesce(dcg, 0.0) / ideal, 6) AS ndcg FROM g LEFT JOIN h ON h.query_id = g.query_id"""


@query("ranking_metrics", RANKING)
def ranking_metrics(m: Model):
    relevant = m.vectors.join(m.vectors.where("vec_id % 100 = 0")
    .select(F.col("vec_id").alias("query_id"), F.col("label").alias("l")), F.col("label") == F.col("l")).select("query_id", "vec_id")
    return Q.ranking_metrics(by_vector(m), relevant, "vec_id", 10)


# ---- streams over the events table
def stream(m: Model):
    schema = m.table("events").schema
    return m.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(m.dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_daily_counts_complete", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts_complete(m: Model):
    return jobs.drain(jobs.windowed_counts(stream(m), "ts", ["event_type"]))


@query("stream_sliding_activity_complete", """SELECT CAST(d AS DATE) AS day, event_type, count(*) AS n FROM (SELECT event_type, CAST(ts AS DATE) - k AS d
  FROM events, (SELECT CAST(unnest(range(7)) AS INT) AS k)) GROUP BY 1, 2""")
def stream_sliding_activity_complete(m: Model):
    return jobs.drain(jobs.windowed_counts(stream(m), "ts", ["event_type"], "7 days", "1 day"))


@query("stream_event_sessions", """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id
    ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n
FROM s GROUP BY user_id, k""")
def stream_event_sessions(m: Model):
    return jobs.drain(jobs.event_sessions(stream(m), "ts", ["user_id"], "1 day"))


def steps(m: Model, n: int = 4):
    """The events in n steps of eight days; of every tenth a step later than its time."""
    e = m.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(n - 1))
    e = e.withColumn("step", F.least(F.when(F.col("event_id") % 10 == 3, own + 1).otherwise(own), F.lit(n - 1)))
    return [e.where(F.col("step") == i).drop("step") for i in range(n)]


#: A row's step, and the watermark then: the newest time of all steps before, less the delay.
LATE = """a AS (SELECT *, CAST(ts AS TIMESTAMP) AS t, CAST(floor((day(CAST(ts AS TIMESTAMP)) - 1) / 8) AS INT) AS own FROM events),
b AS (SELECT *, least(CASE WHEN event_id % 10 = 3 THEN own + 1 ELSE own END, 3) AS step FROM a), mx AS (SELECT step, max(t) AS m FROM b GROUP BY 1),
late AS (SELECT b.*, (SELECT max(mx.m) FROM mx WHERE mx.step < b.step) - INTERVAL {delay} AS wm FROM b), fin AS (SELECT max(t) - INTERVAL {delay} AS wm FROM b)"""


def windows_told(m: Model, size: str, slide: str | None):
    """Finished windows in append mode, and how many of their rows came too late: what all files hold less what the window has."""
    count = lambda e: jobs.windowed_counts(e, "ts", ["event_type"], size, slide, "2 days")
    told, _ = jobs.fed(m.spark, steps(m), count, "append")
    whole = jobs.windowed_counts(m.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], size, slide).withColumnRenamed("n", "all")
    return told.join(whole, ["day", "event_type"]).select("day", "event_type", "n", (F.col("all") - F.col("n")).alias("dropped"))


@query("stream_daily_counts", LATE.replace("{delay}", "2 DAY") + """ SELECT CAST(t AS DATE) AS day, event_type, count(*) FILTER (WHERE wm IS NULL OR CAST(t AS DATE) + INTERVAL 1 DAY > wm) AS n, count(*) FILTER (WHERE CAST(t AS DATE) + INTERVAL 1 DAY <= wm) AS dropped
FROM late, fin f WHERE CAST(t AS DATE) + INTERVAL 1 DAY <= f.wm GROUP BY 1, 2 HAVING count(*) FILTER (WHERE wm IS NULL OR CAST(t AS DATE) + INTERVAL 1 DAY > wm) > 0""".replace("late, fin f", "late l, fin f").replace("wm IS NULL OR", "l.wm IS NULL OR").replace("> wm)", "> l.wm)").replace("<= wm)", "<= l.wm)"))
def stream_daily_counts(m: Model):
    return windows_told(m, "1 day", None)


@query("stream_sliding_activity", LATE.replace("{delay}", "2 DAY") + """, w AS (SELECT l.*, CAST(CAST(t AS DATE) - k AS DATE) AS day FROM late l, (SELECT CAST(unnest(range(7)) AS INT) AS k))
SELECT day, event_type, count(*) FILTER (WHERE w.wm IS NULL OR day + INTERVAL 7 DAY > w.wm) AS n, count(*) FILTER (WHERE day + INTERVAL 7 DAY <= w.wm) AS dropped
FROM w, fin f WHERE day + INTERVAL 7 DAY <= f.wm GROUP BY 1, 2 HAVING count(*) FILTER (WHERE w.wm IS NULL OR day + INTERVAL 7 DAY > w.wm) > 0""")
def stream_sliding_activity(m: Model):
    return windows_told(m, "7 days", "1 day")


SURGES = LATE.replace("{delay}", "4 DAY") + """, kept AS (SELECT event_type, CAST(t AS DATE) AS day, {value} AS x FROM late WHERE (wm IS NULL OR t > wm) AND value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT event_type, day, x, count(*) OVER w AS c, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM kept WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT event_type, day, round(x, 6) AS latest, round(m, 6) AS mean, round((x - m) / s, 6) AS z FROM g, fin WHERE c >= 4 AND s > 0 AND round((x - m) / s, 6) >= 0.5 AND day + INTERVAL 1 DAY <= fin.wm"""


def surges_told(m: Model, value: str | None):
    with rocks(m.spark):
        told, _ = jobs.fed(m.spark, steps(m), lambda e: jobs.surges(e, "event_type", "ts", value, z=0.5, delay="4 days"), "append")
        return told.select(F.col("key").alias("event_type"), "day", F.round("latest", 6).alias("latest"), "mean", "z")


@contextlib.contextmanager
def rocks(spark):
    """State in RocksDB, which map state and timers need; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


query("alert_volume_surge_stream", SURGES.replace("{value}", "CAST(count(*) AS DOUBLE)"))(lambda m: surges_told(m, None))
query("alert_materiality_spike_stream", SURGES.replace("{value}", "avg(CAST(value AS DOUBLE))"))(lambda m: surges_told(m, "value"))


def names_told(m: Model, name):
    """Each name once, over four starts from one checkpoint, in the step that first brings it."""
    with rocks(m.spark):
        told, _ = jobs.fed(m.spark, steps(m), lambda e: jobs.seen_names(e.select(name.alias("name"), F.col("ts").alias("at"))), "append")
        return told.select("name", "at")


FIRST = LATE.replace("{delay}", "1 DAY") + """, f AS (SELECT {name} AS name, min(step) AS step FROM b GROUP BY 1) SELECT f.name, min(b.t) AS "at" FROM f JOIN b ON {name} = f.name AND b.step = f.step GROUP BY 1"""
query("alert_new_entity_stream", FIRST.replace("{name}", "concat(event_type, '_', CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR))"))(
    lambda m: names_told(m, F.concat("event_type", F.lit("_"), F.floor(F.col("value") / 10).cast("string"))))
query("alert_new_event_stream", FIRST.replace("{name}", "user_id"))(lambda m: names_told(m, F.col("user_id")))


#: One step a firing: the next of a rule that is four hours or more after the last one let through.
COOL = """RECURSIVE e AS (SELECT DISTINCT user_id AS rule_id, ts AS t FROM events), r AS (SELECT rule_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT rule_id, t FROM (SELECT e.rule_id, min(e.t) AS t FROM r JOIN e ON e.rule_id = r.rule_id AND e.t >= r.t + INTERVAL 240 MINUTE GROUP BY e.rule_id, r.t)) SELECT rule_id, t AS "at" FROM r"""


@query("alert_cooldown", COOL)
def alert_cooldown(m: Model):
    return S.alert_cooldown(m.table("events").select(F.col("user_id").alias("rule_id"), F.col("ts").alias("at")), 240)
