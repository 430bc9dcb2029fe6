"""Queries of the page-sized bundles, in long form, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bundles as B
from ..operators import events as E
from ..operators import graph as G
from .model import Model
from .queries_counts import BASE, SP, base, pairs
from .registry import query

THIRD = "NOT coalesce(source_geofocus ILIKE concat('%', initiating_country, '%'), false)"


def sect(name: str, key: str, source: str, third: str | None = THIRD, tail: str = "") -> str:
    corroborated = f"count(DISTINCT doc_id) FILTER (WHERE {third})" if third else "NULL"
    return f"SELECT * FROM (SELECT '{name}' AS section, CAST({key} AS VARCHAR) AS key, count(DISTINCT doc_id) AS n_docs, {corroborated} AS corroborated FROM {source} GROUP BY 2 {tail})"


#: Sections of the pairs in `b` (doc_id, date, source_name, source_geofocus, initiating_country, recipient_country).
METRICS = " UNION ALL ".join([
    sect("total", "'documents'", "b"),
    sect("category", "category", "b JOIN cat USING (doc_id)"),
    sect("subcategory", "subcategory", "b JOIN sub USING (doc_id)"),
    sect("initiator", "initiating_country", "b"),
    sect("recipient", "recipient_country", "b"),
    sect("month", "strftime(date, '%Y-%m')", "b", tail="ORDER BY key DESC LIMIT 12"),
    sect("source", "source_name", "b", tail="ORDER BY n_docs DESC, key LIMIT 20"),
])

for _name, _where in (("influencer_metrics", "initiating_country = 'NATION_1'"), ("recipient_metrics", "recipient_country = 'NATION_7'")):
    query(_name, f"{SP}, b AS (SELECT * FROM sp WHERE {_where}) {METRICS}", *BASE, "cat", "sub")(lambda m, w=_where: B.document_metrics(pairs(m).where(w), m.cat, m.sub))


@query("pair_metrics", f"b AS (SELECT d.*, initiating_country, recipient_country FROM d JOIN ic USING (doc_id) JOIN rc USING (doc_id) WHERE initiating_country = 'NATION_3' AND recipient_country = 'NATION_3') {METRICS}", *BASE, "cat", "sub")
def pair_metrics(m: Model):
    """One pair; unlike the others, it has no test that initiator and recipient differ."""
    p = m.d.join(m.ic.where("initiating_country = 'NATION_3'"), "doc_id").join(m.rc.where("recipient_country = 'NATION_3'"), "doc_id")
    return B.document_metrics(p, m.cat, m.sub)


def _drill(name: str, key: str, source: str, tail: str = "") -> str:
    return f"SELECT * FROM (SELECT '{name}' AS section, CAST({key} AS VARCHAR) AS key, count(DISTINCT doc_id) AS n_docs, CAST(NULL AS DATE) AS day FROM {source} GROUP BY 2 {tail})"


DRILL = " UNION ALL ".join([
    _drill("total", "'documents'", "b"),
    "SELECT 'range', 'first', NULL, min(date) FROM b",
    "SELECT 'range', 'last', NULL, max(date) FROM b",
    _drill("category", "category", "b JOIN cat USING (doc_id)"),
    _drill("subcategory", "subcategory", "b JOIN sub USING (doc_id)"),
    _drill("recipient", "recipient_country", "b"),
    _drill("initiator", "initiating_country", "b"),
    _drill("month", "strftime(date, '%Y-%m')", "b"),
    _drill("source", "source_name", "b", "ORDER BY n_docs DESC, key LIMIT 15"),
    """SELECT 'document', CAST(doc_id AS VARCHAR), row_number() OVER (ORDER BY date DESC, doc_id), date
FROM (SELECT DISTINCT doc_id, date FROM b ORDER BY date DESC, doc_id LIMIT 20)""",
])


@query("chart_drilldown", f"{SP}, b AS (SELECT * FROM sp WHERE doc_id IN (SELECT doc_id FROM cat WHERE category = 'LARGE') AND strftime(date, '%Y-%m') = '1997-05') {DRILL}", *BASE, "cat", "sub")
def chart_drilldown(m: Model):
    """A click on May 1997 in a chart of one category."""
    clicked = pairs(m).where(F.date_format("date", "yyyy-MM") == "1997-05").join(m.cat.where("category = 'LARGE'").select("doc_id"), "doc_id", "left_semi")
    return B.drilldown(clicked, m.cat, m.sub)


COMPETING = (
    SP
    + f""", p AS (SELECT DISTINCT doc_id, date, initiating_country, {THIRD} AS third FROM sp WHERE recipient_country = 'NATION_7'),
c AS (SELECT initiating_country, category AS key, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) FILTER (WHERE third) AS corroborated FROM p JOIN cat USING (doc_id) GROUP BY 1, 2),
l AS (SELECT initiating_country, key FROM (SELECT *, row_number() OVER (PARTITION BY initiating_country ORDER BY n_docs DESC, key) AS r FROM c) WHERE r = 1),
a AS (SELECT * FROM ce WHERE master_event_id IS NULL AND id IN (SELECT id FROM rcounts WHERE key = 'NATION_7')),
e AS (SELECT initiating_country, count(*) AS n_events, round(avg(CAST(material_score AS DOUBLE)), 2) AS mean_score FROM a GROUP BY 1),
s AS (SELECT initiating_country, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) FILTER (WHERE third) AS corroborated FROM p GROUP BY 1)
SELECT 'summary' AS section, s.initiating_country, l.key, s.n_docs, s.corroborated, coalesce(e.n_events, 0) AS n_events, e.mean_score, round(1 - s.corroborated / CAST(s.n_docs AS DOUBLE), 3) AS self_share
  FROM s LEFT JOIN l ON l.initiating_country = s.initiating_country LEFT JOIN e ON e.initiating_country = s.initiating_country
UNION ALL SELECT 'month', initiating_country, strftime(date, '%Y-%m'), count(DISTINCT doc_id), NULL, NULL, NULL, NULL FROM p GROUP BY 2, 3
UNION ALL SELECT 'category', initiating_country, key, n_docs, corroborated, NULL, NULL, NULL FROM c
UNION ALL SELECT 'event', initiating_country, CAST(id AS VARCHAR), r, NULL, NULL, CAST(material_score AS DOUBLE), NULL FROM (SELECT *, row_number() OVER (PARTITION BY initiating_country ORDER BY last_mention_date DESC, id) AS r FROM a) WHERE r <= 3"""
)


@query("competing_influence", COMPETING, *BASE, "cat", "ce", "rcounts")
def competing_influence(m: Model):
    out = B.competing_influence(pairs(m), m.cat, m.ce, m.recipient_counts, "NATION_7")
    return out.select("section", "initiating_country", "key", "n_docs", "corroborated", "n_events", "mean_score", "self_share")


REPORT = f"""b AS (SELECT d.*, initiating_country FROM d JOIN ic USING (doc_id) WHERE initiating_country = 'NATION_1' AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'),
x AS ({sect("total", "'documents'", "b")} UNION ALL {sect("category", "category", "b JOIN cat USING (doc_id)")} UNION ALL {sect("subcategory", "subcategory", "b JOIN sub USING (doc_id)")}
  UNION ALL {sect("recipient", "recipient_country", "(SELECT * FROM b JOIN rc USING (doc_id) WHERE recipient_country IN {REC} AND recipient_country <> initiating_country)", tail="ORDER BY n_docs DESC, key LIMIT 20")}
  UNION ALL SELECT 'materiality', concat(CAST(k AS VARCHAR), '-', CAST(k + 1 AS VARCHAR)), (SELECT count(*) FROM ce WHERE initiating_country = 'NATION_1' AND master_event_id IS NULL AND least(CAST(floor(coalesce(material_score, 0)) AS INT), 9) = k), NULL FROM (SELECT CAST(unnest(range(10)) AS INT) AS k))
SELECT *, CASE WHEN section IN ('total', 'recipient') THEN round(corroborated / CAST(n_docs AS DOUBLE), 3) END AS share FROM x"""


@query("report_metrics", REPORT, "d", "rc", "cat", "sub", "ce")
def report_metrics(m: Model):
    docs = m.d.where("date BETWEEN DATE'1997-01-01' AND DATE'1997-12-31'").join(m.ic.where("initiating_country = 'NATION_1'"), "doc_id")
    return B.report_metrics(docs, m.rc, m.cat, m.sub, E.masters(m.ce).where("initiating_country = 'NATION_1'"), m.scope.recipients)


ROLLED = """t AS (SELECT {k}, count(DISTINCT doc_id) AS n, min(date) AS first_day, max(date) AS last_day FROM x GROUP BY {k} HAVING count(DISTINCT doc_id) >= 3),
y AS (SELECT x.* FROM x JOIN t USING ({k})), ev AS (SELECT s.* FROM sc s JOIN t USING ({k})),
z AS (SELECT {k}, 'source' AS section, source_name AS key, count(DISTINCT doc_id) AS n, 30 AS most FROM y GROUP BY ALL
  UNION ALL SELECT {k}, 'month', strftime(date, '%Y-%m'), count(DISTINCT doc_id), 1000000 FROM y GROUP BY ALL
  UNION ALL SELECT {k}, 'subcategory', subcategory, count(DISTINCT y.doc_id), 20 FROM y JOIN sub USING (doc_id) GROUP BY ALL
  {cats}
  UNION ALL SELECT {k}, 'events', period_type, count(*), 1000000 FROM ev GROUP BY ALL
  UNION ALL SELECT {k}, 'score', CAST(CAST(round_even(CAST(material_score AS DOUBLE) * 2, 0) / 2 AS DECIMAL(3,1)) AS VARCHAR), count(*), 1000000 FROM ev WHERE material_score IS NOT NULL GROUP BY ALL)
SELECT {k}, section, key, n, NULL AS first_day, NULL AS last_day, NULL AS mean_score, NULL AS median_score FROM (SELECT *, row_number() OVER (PARTITION BY {k}, section ORDER BY n DESC, key) AS r FROM z WHERE key IS NOT NULL) WHERE r <= most
UNION ALL SELECT t.{k0}, 'total', 'documents', t.n, t.first_day, t.last_day, s.mean_score, s.median_score FROM t LEFT JOIN (SELECT {k}, round(avg(CAST(material_score AS DOUBLE)), 6) AS mean_score, quantile_cont(CAST(material_score AS DOUBLE), 0.5) AS median_score FROM ev GROUP BY {k}) s USING ({k})"""
CATS = "UNION ALL SELECT {k}, 'category', category, count(DISTINCT y.doc_id), 1000000 FROM y JOIN cat USING (doc_id) GROUP BY ALL"


def _rolled(x: str, sc: str, keys: list[str], cats: bool = True) -> str:
    k = ", ".join(keys)
    return f"{SP}, x AS ({x}), sc AS ({sc}), " + ROLLED.replace("{cats}", CATS if cats else "").replace("t.{k0}", ", ".join(f"t.{c}" for c in keys)).replace("{k}", k)


#: Summaries with each recipient and each category that their event's documents have.
SC_PAIR = "SELECT es.initiating_country, r.key AS recipient_country, es.period_type, es.material_score FROM es JOIN rcounts r ON r.id = es.canonical_event_id"
SC_CAT = "SELECT es.initiating_country, c.key AS category, es.period_type, es.material_score FROM es JOIN ccounts c ON c.id = es.canonical_event_id"
SC_BOTH = """SELECT es.initiating_country, r.key AS recipient_country, c.key AS category, es.period_type, es.material_score
FROM es JOIN rcounts r ON r.id = es.canonical_event_id JOIN ccounts c ON c.id = es.canonical_event_id"""
RU = ("d", "ic", "rc", "cat", "sub", "es", "rcounts", "ccounts")


def summaries_by(m: Model, *dims: str):
    s = m.es.select(F.col("canonical_event_id").alias("id"), "initiating_country", "period_type", "material_score")
    for counts, name in ((m.recipient_counts, "recipient_country"), (m.category_counts, "category")):
        if name in dims:
            s = s.join(counts.select("id", F.col("key").alias(name)), "id")
    return s.drop("id")


@query("pair_rollup", _rolled("SELECT * FROM sp", SC_PAIR, ["initiating_country", "recipient_country"]), *RU)
def pair_rollup(m: Model):
    dims = {"category": (m.cat, "category", None), "subcategory": (m.sub, "subcategory", 20)}
    return B.rollup(pairs(m), ["initiating_country", "recipient_country"], dims, summaries_by(m, "recipient_country"), 3)


@query("country_category_rollup", _rolled("SELECT * FROM sp JOIN cat USING (doc_id)", SC_CAT, ["initiating_country", "category"], False), *RU)
def country_category_rollup(m: Model):
    return B.rollup(pairs(m).join(m.cat, "doc_id"), ["initiating_country", "category"], {"subcategory": (m.sub, "subcategory", 20)}, summaries_by(m, "category"), 3)


@query("pair_category_rollup", _rolled("SELECT * FROM sp JOIN cat USING (doc_id)", SC_BOTH, ["initiating_country", "recipient_country", "category"], False), *RU)
def pair_category_rollup(m: Model):
    keys = ["initiating_country", "recipient_country", "category"]
    return B.rollup(pairs(m).join(m.cat, "doc_id"), keys, {"subcategory": (m.sub, "subcategory", 20)}, summaries_by(m, "recipient_country", "category"), 3)


EVIDENCE = """o AS (SELECT id, initiating_country, total_articles, last_mention_date FROM ce WHERE canonical_name ILIKE '%vent 5%' ORDER BY canonical_name <> 'vent 5', total_articles DESC, id LIMIT 1),
x AS (SELECT DISTINCT d.doc_id, d.date, coalesce(d.source_name, '(unknown)') AS source_name, left(d.distilled_text, 320) AS snippet, coalesce(d.source_geofocus ILIKE concat('%', o.initiating_country, '%'), false) AS self_reported FROM dem_docs m JOIN o ON o.id = m.canonical_event_id JOIN d ON d.doc_id = m.doc_id)
SELECT 'event' AS section, CAST(id AS VARCHAR) AS key, total_articles AS n_docs, last_mention_date AS day, NULL AS snippet, NULL AS self_reported FROM o
UNION ALL SELECT 'total', 'documents', count(*), NULL, NULL, NULL FROM x UNION ALL SELECT 'total', 'third-party documents', count(*) FILTER (WHERE NOT self_reported), NULL, NULL, NULL FROM x UNION ALL SELECT 'total', 'sources', count(DISTINCT source_name), NULL, NULL, NULL FROM x
UNION ALL SELECT * FROM (SELECT 'source', source_name, count(*) AS n, NULL, NULL, bool_or(self_reported) FROM x GROUP BY 2 ORDER BY n DESC, 2 LIMIT 15)
UNION ALL SELECT * FROM (SELECT 'document', CAST(doc_id AS VARCHAR), NULL, date, snippet, self_reported FROM x ORDER BY date DESC, doc_id LIMIT 60)"""


@query("event_evidence", EVIDENCE, "ce", "d")
def event_evidence(m: Model):
    """No event has exactly this name, so the second tier decides."""
    return B.event_evidence("vent 5", m.ce, m.event_docs, m.d)


TOP2 = """(SELECT id, string_agg(key, ', ' ORDER BY n DESC, key) AS {a}
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, key) AS r FROM {t})
  WHERE r <= {k} GROUP BY id)"""


def _top(table: str, alias: str, k: int) -> str:
    return TOP2.replace("{t}", table).replace("{a}", alias).replace("{k}", str(k))


def names(column: str):
    return F.array_join(column, ", ").alias(column)


FEED = f"""f AS (SELECT x.canonical_event_id, x.mention_date, x.article_count, ce.canonical_name, CAST(ce.material_score AS DOUBLE) AS material_score FROM dem x JOIN ce ON ce.id = x.canonical_event_id
WHERE ce.master_event_id IS NULL AND ce.initiating_country = 'NATION_1' ORDER BY 2 DESC, 1 LIMIT 30)
SELECT f.*, c.categories, r.recipients FROM f LEFT JOIN {_top("ccounts", "categories", 2)} c ON c.id = f.canonical_event_id LEFT JOIN {_top("rcounts", "recipients", 2)} r ON r.id = f.canonical_event_id"""


@query("actor_timeline_feed", FEED, "ce", "rcounts", "ccounts")
def actor_timeline_feed(m: Model):
    """One page of the newest mentions of an actor's master events."""
    one = E.masters(m.ce).where("initiating_country = 'NATION_1'").select(F.col("id").alias("canonical_event_id"), "canonical_name", F.col("material_score").cast("double").alias("material_score"))
    f = E.top_k(m.dem.join(one, "canonical_event_id")
    .select("canonical_event_id", "mention_date", "article_count", "canonical_name", "material_score"), [F.desc("mention_date"), F.asc("canonical_event_id")], 30)
    return _with_names(m, f, "canonical_event_id", 2).select("canonical_event_id", "mention_date", "article_count", "canonical_name", "material_score", names("categories"), names("recipients"))


def _with_names(m: Model, f, key: str, recipients: int, categories: int = 2):
    """A page of events with their leading categories and recipients, counted for that page only."""
    page = f.select(F.col(key).alias("id")).distinct()
    for counts, name, k in ((m.category_counts, "categories", categories), (m.recipient_counts, "recipients", recipients)):
        f = f.join(B.top_keys(counts.join(page, "id", "left_semi"), k, name).withColumnRenamed("id", key), key, "left")
    return f


PHASED = """r AS (SELECT max(last_mention_date) AS ref FROM ce), ph AS (SELECT ce.*, CASE WHEN ref - last_mention_date > 30 THEN 'dormant' WHEN ref - last_mention_date > 14 THEN 'fading' WHEN ref - first_mention_date <= 7 THEN 'emerging'
WHEN total_articles >= 5 * greatest(total_mention_days, 1) AND total_mention_days >= 3 THEN 'peak' ELSE 'developing' END AS phase FROM ce, r)"""
LISTED = f"""{PHASED}, f AS (SELECT id, canonical_name, first_mention_date, last_mention_date, total_articles, phase, CAST(material_score AS DOUBLE) AS material_score FROM ph
WHERE master_event_id IS NULL AND first_mention_date <= DATE '2024-01-25' AND last_mention_date >= DATE '2024-01-05' AND id IN (SELECT id FROM rcounts WHERE key = 'NATION_2') ORDER BY material_score DESC NULLS LAST, id LIMIT 10 OFFSET 5)
SELECT f.*, c.category, x.recipients FROM f LEFT JOIN {_top("ccounts", "category", 1)} c ON c.id = f.id LEFT JOIN {_top("rcounts", "recipients", 3)} x ON x.id = f.id"""


@query("events_list", LISTED, "ce", "rcounts", "ccounts")
def events_list(m: Model):
    """Filtered by span and recipient, sorted by score, second page of five, each with its phase, leading category and three recipients."""
    e = E.masters(E.with_phase(m.ce)).where("first_mention_date <= DATE'2024-01-25' AND last_mention_date >= DATE'2024-01-05'").join(m.recipient_counts.where("key = 'NATION_2'")
    .select("id"), "id", "left_semi")
    e = e.select("id", "canonical_name", "first_mention_date", "last_mention_date", "total_articles", "phase", F.col("material_score").cast("double").alias("material_score"))
    f = e.orderBy(F.desc_nulls_last("material_score"), "id").offset(5).limit(10)
    return _with_names(m, f, "id", 3, 1).select("id", "canonical_name", "first_mention_date", "last_mention_date", "total_articles", "phase", "material_score", names("categories").alias("category"), names("recipients"))


#: Narratives as the three generators name their parts.
NARRATED = """na AS (SELECT es.*, CASE WHEN total_documents % 3 = 0 THEN concat('{"overview": "', event_name, ' grows", "outcomes": "outcome ', CAST(total_documents AS VARCHAR), '"}')
WHEN total_documents % 3 = 1 THEN concat('{"monthly_overview": "', event_name, ' slows", "key_outcomes": "result ', CAST(total_documents AS VARCHAR), '"}') ELSE '{"yearly_overview": "quiet"}' END AS narrative FROM es)"""
OVERVIEW = "coalesce(narrative ->> '$.overview', narrative ->> '$.monthly_overview', narrative ->> '$.yearly_overview', '') AS overview"
OUTCOMES = "coalesce(narrative ->> '$.outcomes', narrative ->> '$.key_outcomes', narrative ->> '$.annual_outcomes', '') AS outcomes"


def narrated(m: Model):
    n, e = F.col("total_documents"), F.col("event_name")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    narrative = F.when(n % 3 == 0, text('{"overview": "', e, ' grows", "outcomes": "outcome ', n, '"}')).when(n % 3 == 1, text('{"monthly_overview": "', e, ' slows", "key_outcomes": "result ', n, '"}')).otherwise('{"yearly_overview": "quiet"}')
    return m.es.withColumn("narrative", narrative)


@query("summaries_list", f"{NARRATED}, f AS (SELECT * FROM na WHERE period_type = 'daily' AND initiating_country = 'NATION_1' ORDER BY period_start DESC, es_id LIMIT 30 OFFSET 10) SELECT es_id, period_start, period_end, event_name, CAST(material_score AS DOUBLE) AS material_score, total_documents, {OVERVIEW}, {OUTCOMES} FROM f", "es")
def summaries_list(m: Model):
    f = narrated(m).where("period_type = 'daily' AND initiating_country = 'NATION_1'").orderBy(F.desc("period_start"), "es_id").offset(10).limit(30)
    return E.with_narrative(f).select("es_id", "period_start", "period_end", "event_name", F.col("material_score").cast("double").alias("material_score"), "total_documents", "overview", "outcomes")


@query("search_summaries", f"{NARRATED}, p AS (SELECT *, {OVERVIEW}, {OUTCOMES} FROM na) SELECT es_id, total_documents, CASE WHEN event_name ILIKE '%3%' THEN 'name' WHEN overview ILIKE '%3%' THEN 'overview' ELSE 'outcomes' END AS found_in FROM p WHERE event_name ILIKE '%3%' OR overview ILIKE '%3%' OR outcomes ILIKE '%3%' ORDER BY total_documents DESC, es_id LIMIT 50", "es")
def search_summaries(m: Model):
    """In name, overview or outcomes, whichever key of the narrative holds these."""
    return E.search_summaries(E.with_narrative(narrated(m)), "3", 50)


#: Weekly summaries whose event is known by name only, as their generator leaves them.
WEEKLY = """w AS (SELECT initiating_country, event_name, CAST(date_trunc('week', period_start) AS DATE) AS period_start, CAST(sum(total_documents) AS BIGINT) AS total_documents, concat('W', initiating_country, '|', event_name, '|', CAST(CAST(date_trunc('week', period_start) AS DATE) AS VARCHAR)) AS es_id FROM es GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(event_name)), initiating_country ORDER BY period_start DESC, es_id) AS r FROM w),
l AS (SELECT k.*, (SELECT min(id) FROM ce WHERE ce.master_event_id IS NULL AND ce.canonical_name = k.event_name AND ce.initiating_country = k.initiating_country) AS canonical_event_id FROM k WHERE r = 1)
SELECT * FROM (SELECT 'overall' AS section, es_id, initiating_country, period_start, total_documents, canonical_event_id FROM l ORDER BY period_start DESC, total_documents DESC, es_id LIMIT 10)
UNION ALL SELECT 'by actor', es_id, initiating_country, period_start, total_documents, canonical_event_id FROM (SELECT *, row_number() OVER (PARTITION BY initiating_country ORDER BY period_start DESC, total_documents DESC, es_id) AS q FROM l) WHERE q <= 5"""


@query("intelligence_feed", WEEKLY, "es")
def intelligence_feed(m: Model):
    """The newest weekly summaries, one an event, ten overall and five an actor, with the events that they belong to."""
    week = F.trunc("period_start", "week").alias("period_start")
    w = m.es.groupBy("initiating_country", "event_name", week).agg(F.sum("total_documents").alias("total_documents"))
    w = w.withColumns({"es_id": F.concat(F.lit("W"), "initiating_country", F.lit("|"), "event_name", F.lit("|"), F.col("period_start").cast("string")), "canonical_event_id": F.lit(None).cast("long")})
    return E.intelligence_feed(w, m.ce)


CONTEXT = """x AS (SELECT DISTINCT es.*, r.key AS recipient FROM es JOIN rcounts r ON r.id = es.canonical_event_id),
p AS (SELECT 'pair' AS section, es_id, initiating_country, recipient AS about, total_documents, row_number() OVER (PARTITION BY initiating_country, recipient ORDER BY period_start DESC, es_id) AS r, 1 AS most FROM x WHERE recipient IN {REC}),
c AS (SELECT 'category', es_id, es.initiating_country, c.key, total_documents, row_number() OVER (PARTITION BY es.initiating_country, c.key ORDER BY period_start DESC, es_id), 1 FROM es JOIN ccounts c ON c.id = es.canonical_event_id),
t AS (SELECT 'recipient', es_id, initiating_country, recipient, total_documents, row_number() OVER (PARTITION BY recipient ORDER BY total_documents DESC, es_id), 5 FROM x WHERE recipient IN {REC})
SELECT section, es_id, initiating_country, about, total_documents FROM (SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM t) WHERE r <= most"""


@query("strategic_context", CONTEXT, "es", "rcounts", "ccounts")
def strategic_context(m: Model):
    """For every scope that a question may name: the newest summary of a pair and of an actor's category, and the five largest about a recipient."""
    return E.strategic_context(m.es, m.recipient_counts.where(F.col("key").isin(*m.scope.recipients)), m.category_counts)


VALIDATE = """p AS (SELECT doc_id, date, source_name, initiating_country FROM d JOIN ic USING (doc_id) WHERE medium <> 'P' UNION ALL SELECT doc_id, date, source_name, initiating_country FROM d JOIN ic USING (doc_id) WHERE medium = 'O' AND doc_id % 5 = 0),
j AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'length mismatch' ELSE 'no salience' END AS reason FROM d WHERE medium = 'P'),
i AS (SELECT doc_id, count(*) AS c, min(date) AS date, doc_id % 3 = 0 AS known FROM p GROUP BY 1),
g AS (SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM j) AS total, (SELECT count(*) FROM p) AS parseable, (SELECT count(*) FROM j) AS errors, count(*) FILTER (WHERE NOT known) AS fresh, count(*) FILTER (WHERE known) AS existing, CAST(sum(c - 1) AS BIGINT) AS dups, count(*) FILTER (WHERE date IS NULL) AS undated FROM i),
m AS (SELECT 'total' AS metric, total AS n FROM g UNION ALL SELECT 'parseable', parseable FROM g UNION ALL SELECT 'errors', errors FROM g UNION ALL SELECT 'new', fresh FROM g UNION ALL SELECT 'existing', existing FROM g UNION ALL SELECT 'duplicates in file', dups FROM g UNION ALL SELECT 'without date', undated FROM g)
SELECT metric, NULL AS key, n, NULL AS day FROM m UNION ALL SELECT 'date range', 'first', NULL, min(date) FROM p UNION ALL SELECT 'date range', 'last', NULL, max(date) FROM p
UNION ALL SELECT * FROM (SELECT 'top sources', source_name, count(*) AS n, NULL FROM p GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'top countries', initiating_country, count(*) AS n, NULL FROM p GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)
UNION ALL SELECT 'error', reason, count(*), NULL FROM j GROUP BY 2 UNION ALL SELECT 'warning', metric, n, NULL FROM m WHERE metric IN ('errors', 'duplicates in file', 'existing', 'without date') AND n > 0"""


@query("validate_batch", VALIDATE, "d")
def validate_batch(m: Model):
    d = m.d.join(m.ic, "doc_id").select("doc_id", "date", "source_name", "initiating_country", "medium")
    parsed = d.where("medium <> 'P'").unionByName(d.where("medium = 'O' AND doc_id % 5 = 0"))
    rejects = d.where("medium = 'P'").select(F.when(F.col("doc_id") % 2 == 0, "length mismatch").otherwise("no salience").alias("reason"))
    return B.validation_report(parsed, rejects, m.d.where("doc_id % 3 = 0").select("doc_id"), {"sources": "source_name", "countries": "initiating_country"})


@query("period_ranges", """s AS (SELECT min(mention_date) AS a, max(mention_date) AS z FROM dem),
u AS (SELECT 'week' AS unit, p, p + 6 AS q FROM (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', a) AS DATE), z, INTERVAL 7 DAY)) AS DATE) AS p
    FROM s) UNION ALL SELECT 'month', p, CAST(p + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE)
  FROM (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', a) AS DATE), z, INTERVAL 1 MONTH)) AS DATE) AS p
    FROM s) UNION ALL SELECT 'year', p, CAST(p + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE)
  FROM (SELECT CAST(unnest(generate_series(CAST(date_trunc('year', a) AS DATE), z, INTERVAL 1 YEAR)) AS DATE) AS p
    FROM s)) SELECT unit, greatest(p, a) AS period_start, least(q, z) AS period_end
FROM u, s""", "dem")
def period_ranges(m: Model):
    """Weeks, months and years of the mentions that the table holds."""
    span = m.dem.agg(F.min("mention_date").alias("s"), F.max("mention_date").alias("e"))
    return B.stacked([E.ranges_of(span, unit).select(F.lit(unit).alias("unit"), "period_start", "period_end") for unit in ("week", "month", "year")])
