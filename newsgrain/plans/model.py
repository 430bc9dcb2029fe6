"""The document / event / entity model over the driver's tables, as DataFrames and as the SQL that the oracles start from."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.fact_store import FactStore
from ..operators.store import shared_dir, written
from ..scope import TEST_SCOPE, Scope


class Model:
    """Frames of one data folder. The bridges and documents are facts, written once for the files they come from; all else is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.scope = spark, sf_dir, TEST_SCOPE

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def facts(self) -> FactStore:
        """Facts that queries share, under the folder that they are derived from."""
        return FactStore(self.spark, f"{shared_dir(self.spark)}/facts/{hashlib.md5(self.dir.encode()).hexdigest()[:12]}")

    def inputs(self, *tables: str) -> list[str]:
        return [f"{self.dir}/{t}.parquet" for t in tables]

    @cached_property
    def nation(self) -> DataFrame:
        return F.broadcast(self.table("nation").select("n_nationkey", "n_name"))  # 25 rows by definition

    @cached_property
    def ic(self) -> DataFrame:
        return self.facts.whole("ic", self.inputs("orders", "customer", "nation"), self._ic, "doc_id")

    def _ic(self) -> DataFrame:
        return self._orders(self.table("customer")).select("doc_id", "initiating_country")

    def _orders(self, customers: DataFrame) -> DataFrame:
        o = self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return o.withColumns({"doc_id": F.col("o_orderkey"), "initiating_country": F.col("n_name")})

    @cached_property
    def rc(self) -> DataFrame:
        return self.facts.whole("rc", self.inputs("lineitem", "supplier", "nation"), self._rc, "doc_id", distinct=True)

    def _rc(self, lines: DataFrame | None = None) -> DataFrame:
        # names come last: the planner takes a join for as large as both its sides multiplied, and would not broadcast suppliers with their names
        s = (self.table("lineitem") if lines is None else lines).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return s.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("n_name").alias("recipient_country"))

    def _part(self, column: str, name: str, lines: DataFrame | None = None) -> DataFrame:
        return (self.table("lineitem") if lines is None else lines).join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col(column).alias(name))

    @cached_property
    def cat(self) -> DataFrame:
        return self.facts.whole("cat", self.inputs("lineitem", "part"), self._cat, "doc_id", distinct=True)

    def _cat(self, lines: DataFrame | None = None) -> DataFrame:
        return self._part("p_type", "category", lines)

    @cached_property
    def sub(self) -> DataFrame:
        return self.facts.whole("sub", self.inputs("lineitem", "part"), self._sub, "doc_id", distinct=True)

    def _sub(self) -> DataFrame:
        return self._part("p_brand", "subcategory")

    @cached_property
    def d(self) -> DataFrame:
        return self.facts.whole("d", self.inputs("orders", "customer", "nation"), self._d, "doc_id")

    def _d(self) -> DataFrame:
        # an order has one customer, so its country comes with the same join
        return self._described(self._orders(self.table("customer")))

    def _described(self, o: DataFrame, *more: str) -> DataFrame:
        geo = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_custkey") % 3 == 0, F.col("initiating_country")).otherwise("NATION_24")
        return o.select("doc_id", F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("source_name"), geo.alias("source_geofocus"), F.col("o_orderstatus").alias("medium"), F.concat(F.lit("Doc "), (F.col("doc_id") % 97).cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("title"), F.concat(F.lit("Total "), F.floor("o_totalprice").cast("string")).alias("distilled_text"), *more)

    def of_initiator(self, country: str, scope: Scope) -> tuple[DataFrame, ...]:
        """d, ic, rc and cat of one initiator's documents in a scope's days, straight from the tables. Facts hold all documents; one country's are few, so customers, orders and lines are cut down to
        them one after the other. Each is written, so that the planner knows how small it is."""
        ours = self.table("customer").join(self.nation.where(F.col("n_name") == country), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey")
        o = self._orders(written(ours, "customers")[0]).where((F.col("o_orderdate") >= F.lit(scope.start).cast("date")) & (F.col("o_orderdate") < F.lit(scope.end).cast("date")))
        docs, _ = written(self._described(o, "initiating_country"), "documents")
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(docs.select("doc_id"), F.col("l_orderkey") == F.col("doc_id"), "left_semi")
        lines, _ = written(lines, "lines")
        return docs.drop("initiating_country"), docs.select("doc_id", "initiating_country"), self._rc(lines).distinct(), self._cat(lines).distinct()

    def least(self, lines: DataFrame, column: str, names: DataFrame) -> DataFrame:
        """doc_id and the place of the least name of its lines. names: a closed list that has them all; places are counted from where ZZZ, which stands for no name, would be. The least number is found
        in part before a shuffle, the least string only by sorting all."""
        every = names.toDF("name").where("name IS NOT NULL").union(self.spark.sql("SELECT 'ZZZ'")).distinct().withColumn("at", F.row_number().over(W.orderBy("name")))
        ranks, _ = written(every.withColumn("at", F.col("at") - F.max(F.when(F.col("name") == "ZZZ", F.col("at"))).over(W.partitionBy())), "ranks")
        return lines.join(ranks, F.col(column) == F.col("name")).groupBy("doc_id").agg(F.min("at").alias(column))

    def first_names(self) -> tuple[DataFrame, DataFrame]:
        """Of each document with lines, the places of its first recipient and of its first category, straight from the tables."""
        # lines lie by part after the join with parts, if those are many: to group them there in part takes memory and makes them no fewer
        return self.least(self._rc(), "recipient_country", self.table("nation").select("n_name")), self.least(self._cat().repartition("doc_id"), "category", self.table("part").select("p_type").distinct())

    @cached_property
    def dem_docs(self) -> DataFrame:
        return self.facts.whole("mentions", self.inputs("events", "orders"), self._dem_docs, "doc_id", distinct=True)

    def _dem_docs(self) -> DataFrame:
        # position of each order in key order: counts before each range of keys, then places within ranges
        orders = self.table("orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 65536).alias("range"))
        before = orders.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        rk = orders.withColumn("at", F.row_number().over(W.partitionBy("range").orderBy("o_orderkey")) - 1).join(before, "range").select("o_orderkey", (F.col("before") + F.col("at")).alias("rn"))
        n = orders.agg(F.count("*").alias("n"))
        # an eighth of the documents carries all mentions, so that entities meet in documents
        e = self.table("events").crossJoin(F.broadcast(n)).withColumn("rn", F.col("event_id") % F.greatest(F.floor(F.col("n") / 8), F.lit(1)))
        return e.join(rk, "rn").select(F.col("user_id").alias("canonical_event_id"), F.to_date("ts").alias("mention_date"), F.col("o_orderkey").alias("doc_id"), F.concat("event_type", F.lit("_"), F.floor(F.col("value") / 10).cast("string")).alias("entity"))

    @cached_property
    def event_docs(self) -> DataFrame:
        return self.dem_docs.select("canonical_event_id", "mention_date", "doc_id").distinct()

    @cached_property
    def dem(self) -> DataFrame:
        return self.event_docs.groupBy("canonical_event_id", "mention_date").agg(F.count("*").alias("article_count"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))

    @cached_property
    def ce(self) -> DataFrame:
        i = F.col("canonical_event_id")
        g = self.event_docs.groupBy("canonical_event_id", "mention_date").count().groupBy("canonical_event_id").agg(F.min("mention_date").alias("first_mention_date"), F.max("mention_date").alias("last_mention_date"), F.sum("count").alias("total_articles"), F.count("*").alias("total_mention_days"))
        return g.select(
            i.alias("id"),
            F.concat(F.lit("Event "), (i % 40).cast("string")).alias("canonical_name"),
            F.when((i % 5 == 0) | (i % 50 > 44), None).otherwise(i - i % 5).alias("master_event_id"),
            F.concat(F.lit("NATION_"), (F.floor((i - i % 5) / 5) % 5).cast("string")).alias("initiating_country"),
            "first_mention_date",
            "last_mention_date",
            "total_articles",
            "total_mention_days",
            F.when(i % 7 == 0, None).otherwise((1 + i % 10).cast("decimal(3,1)")).alias("material_score"),
        )

    def _counts(self, bridge: DataFrame, name: str) -> DataFrame:
        return self.event_docs.select("canonical_event_id", "doc_id").distinct().join(bridge, "doc_id").groupBy(F.col("canonical_event_id").alias("id"), F.col(name).alias("key")).agg(F.count("*").alias("n"))

    @cached_property
    def recipient_counts(self) -> DataFrame:
        return self._counts(self.rc, "recipient_country")

    @cached_property
    def category_counts(self) -> DataFrame:
        return self._counts(self.cat, "category")

    @cached_property
    def ce_maps(self) -> DataFrame:
        """ce with the count maps primary_recipients and primary_categories."""
        as_map = lambda c, name: c.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias(name))
        return self.ce.join(as_map(self.recipient_counts, "primary_recipients"), "id", "left").join(as_map(self.category_counts, "primary_categories"), "id", "left")

    @cached_property
    def es(self) -> DataFrame:
        """Daily event summaries of master events."""
        m = self.ce.where("master_event_id IS NULL")
        e = self.event_docs.join(self.ce.select(F.col("id").alias("canonical_event_id"), F.coalesce("master_event_id", "id").alias("master")), "canonical_event_id")
        g = e.groupBy("master", "mention_date").agg(F.count_distinct("doc_id").alias("total_documents")).where("total_documents >= 3")
        return g.join(m.withColumnRenamed("id", "master"), "master").select(
            F.concat(F.lit("D"), F.col("master").cast("string"), F.lit("-"), F.col("mention_date").cast("string")).alias("es_id"), F.lit("daily").alias("period_type"), F.col("mention_date").alias("period_start"), F.col("mention_date").alias("period_end"),
            F.col("canonical_name").alias("event_name"), "initiating_country", "total_documents", "material_score", F.when(F.col("master") % 4 == 0, None).otherwise(F.col("master")).alias("canonical_event_id"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """es_id, doc_id of the daily summaries."""
        e = self.event_docs.join(self.ce.select(F.col("id").alias("canonical_event_id"), F.coalesce("master_event_id", "id").alias("master")), "canonical_event_id")
        es_id = F.concat(F.lit("D"), F.col("master").cast("string"), F.lit("-"), F.col("mention_date").cast("string"))
        return e.select(es_id.alias("es_id"), "doc_id").distinct().join(self.es.select("es_id"), "es_id", "left_semi")

    @cached_property
    def den(self) -> DataFrame:
        return self.dem_docs.select("entity", "mention_date", "doc_id").distinct()

    @cached_property
    def cen(self) -> DataFrame:
        return self.den.groupBy("entity").agg(F.count_distinct("doc_id").alias("total_documents"), F.min("mention_date").alias("first_mention_date"), F.max("mention_date").alias("last_mention_date")).withColumn("entity_type", F.split_part("entity", F.lit("_"), F.lit(1)))

    @cached_property
    def raw_events(self) -> DataFrame:
        return self._raw_events().distinct()

    def _raw_events(self) -> DataFrame:
        """A row a line of an order."""
        j = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return j.select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("event_name"), F.when(F.col("l_linenumber") == 1, F.concat("p_brand", F.lit(" "), "p_name")).alias("specific_event_name"))

    @cached_property
    def vectors(self) -> DataFrame:
        v = self.table("embeddings")
        return v.select("vec_id", "embedding", "label", F.concat(F.lit("NATION_"), (F.col("vec_id") % 5).cast("string")).alias("country"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 40).cast("int")).alias("day"))


#: The same model in SQL that both engines run.
CTES = {
    "ic": "SELECT o.o_orderkey AS doc_id, n.n_name AS initiating_country FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey",
    "rc": """SELECT DISTINCT l.l_orderkey AS doc_id, n.n_name AS recipient_country
FROM lineitem l JOIN supplier sp ON l.l_suppkey=sp.s_suppkey JOIN nation n ON sp.s_nationkey=n.n_nationkey""",
    "cat": "SELECT DISTINCT l.l_orderkey AS doc_id, p.p_type AS category FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey",
    "sub": "SELECT DISTINCT l.l_orderkey AS doc_id, p.p_brand AS subcategory FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey",
    "d": """SELECT o.o_orderkey AS doc_id, CAST(o.o_orderdate AS DATE) AS date, o.o_orderpriority AS source_name, CASE WHEN o.o_orderstatus='P' THEN NULL WHEN o.o_custkey % 3 = 0 THEN ic.initiating_country ELSE 'NATION_24' END AS source_geofocus, o.o_orderstatus AS medium, concat('Doc ', CAST(o.o_orderkey % 97 AS VARCHAR), ' ', o.o_orderpriority) AS title, concat('Total ', CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR)) AS distilled_text
FROM orders o JOIN ic ON ic.doc_id=o.o_orderkey""",
    "rk": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders",
    "ent_docs": """SELECT DISTINCT e.user_id AS canonical_event_id, CAST(e.ts AS DATE) AS mention_date, rk.o_orderkey AS doc_id, concat(e.event_type, '_', CAST(CAST(floor(e.value / 10) AS BIGINT) AS VARCHAR)) AS entity
FROM events e JOIN rk ON e.event_id % greatest(rk.n // 8, 1) = rk.rn""",
    "dem_docs": "SELECT DISTINCT canonical_event_id, mention_date, doc_id FROM ent_docs",
    "dem": "SELECT canonical_event_id, mention_date, count(*) AS article_count FROM dem_docs GROUP BY 1,2",
    "ce": """SELECT canonical_event_id AS id, concat('Event ', CAST(canonical_event_id % 40 AS VARCHAR)) AS canonical_name, CASE WHEN canonical_event_id % 5 = 0 OR canonical_event_id % 50 > 44 THEN NULL ELSE canonical_event_id - canonical_event_id % 5 END AS master_event_id, concat('NATION_', CAST(CAST((canonical_event_id - canonical_event_id % 5) / 5 AS BIGINT) % 5 AS VARCHAR)) AS initiating_country, min(mention_date) AS first_mention_date, max(mention_date) AS last_mention_date, CAST(sum(article_count) AS BIGINT) AS total_articles, count(*) AS total_mention_days, CASE WHEN canonical_event_id % 7 = 0 THEN NULL ELSE CAST(1 + canonical_event_id % 10 AS DECIMAL(3,1)) END AS material_score
FROM dem GROUP BY canonical_event_id""",
    "rcounts": """SELECT x.canonical_event_id AS id, rc.recipient_country AS key, count(*) AS n
FROM (SELECT DISTINCT canonical_event_id, doc_id FROM dem_docs) x
JOIN rc ON rc.doc_id = x.doc_id GROUP BY 1,2""",
    "ccounts": """SELECT x.canonical_event_id AS id, cat.category AS key, count(*) AS n
FROM (SELECT DISTINCT canonical_event_id, doc_id FROM dem_docs) x
JOIN cat ON cat.doc_id = x.doc_id GROUP BY 1,2""",
    "fam": "SELECT id, coalesce(master_event_id, id) AS master FROM ce",
    "fdocs": "SELECT DISTINCT fam.master, x.mention_date, x.doc_id FROM dem_docs x JOIN fam ON fam.id = x.canonical_event_id",
    "es": """SELECT concat('D', CAST(g.master AS VARCHAR), '-', CAST(g.mention_date AS VARCHAR)) AS es_id, 'daily' AS period_type, g.mention_date AS period_start, g.mention_date AS period_end, m.canonical_name AS event_name, m.initiating_country, g.n AS total_documents, m.material_score, CASE WHEN g.master % 4 = 0 THEN NULL ELSE g.master END AS canonical_event_id
FROM (SELECT master, mention_date, count(DISTINCT doc_id) AS n
  FROM fdocs GROUP BY 1,2 HAVING count(DISTINCT doc_id) >= 3) g
JOIN ce m ON m.id = g.master AND m.master_event_id IS NULL""",
    "links": "SELECT es.es_id, f.doc_id FROM fdocs f JOIN es ON es.es_id = concat('D', CAST(f.master AS VARCHAR), '-', CAST(f.mention_date AS VARCHAR))",
    "den": "SELECT DISTINCT entity, mention_date, doc_id FROM ent_docs",
    "cen": """SELECT entity, count(DISTINCT doc_id) AS total_documents, min(mention_date) AS first_mention_date, max(mention_date) AS last_mention_date, split_part(entity, '_', 1) AS entity_type
FROM den GROUP BY entity""",
    "raw_events": """SELECT DISTINCT l.l_orderkey AS doc_id, p.p_name AS event_name, CASE WHEN l.l_linenumber = 1 THEN concat(p.p_brand, ' ', p.p_name) END AS specific_event_name
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "rb": """SELECT d.doc_id, d.date, CAST(date_trunc('month', d.date) AS DATE) AS month, ic.initiating_country, rc.recipient_country, cat.category, d.source_name, d.source_geofocus, d.source_geofocus ILIKE concat('%', ic.initiating_country, '%') AS self_reported, d.source_geofocus ILIKE concat('%', rc.recipient_country, '%') AS recipient_focused
FROM d JOIN ic ON ic.doc_id = d.doc_id JOIN rc ON rc.doc_id = d.doc_id
JOIN cat ON cat.doc_id = d.doc_id WHERE ic.initiating_country IN {INF} AND rc.recipient_country IN {REC} AND cat.category IN {CAT} AND ic.initiating_country <> rc.recipient_country AND d.date >= DATE '1996-01-01' AND d.date < DATE '2001-01-01'""",
    "pi": """SELECT initiating_country, recipient_country, category, month, count(DISTINCT doc_id) AS raw_docs, count(DISTINCT doc_id) FILTER (WHERE self_reported) AS self_docs, count(DISTINCT doc_id) FILTER (WHERE NOT self_reported) AS third_docs, count(DISTINCT doc_id) FILTER (WHERE recipient_focused) AS recipient_focused_docs, count(DISTINCT source_name) AS distinct_sources
FROM rb GROUP BY 1,2,3,4""",
    "vectors": "SELECT vec_id, embedding, label, concat('NATION_', CAST(vec_id % 5 AS VARCHAR)) AS country, DATE '2024-01-01' + CAST(vec_id % 40 AS INT) AS day FROM embeddings",
}
_list = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
NAMES = {"{INF}": _list(TEST_SCOPE.influencers), "{REC}": _list(TEST_SCOPE.recipients), "{CAT}": _list(TEST_SCOPE.categories)}
_needs = {"d": ["ic"], "ent_docs": ["rk"], "dem_docs": ["ent_docs"], "dem": ["dem_docs"], "ce": ["dem"], "rcounts": ["dem_docs", "rc"], "ccounts": ["dem_docs", "cat"], "fam": ["ce"], "fdocs": ["fam", "dem_docs"], "es": ["fdocs", "ce"], "links": ["fdocs", "es"], "den": ["ent_docs"], "cen": ["den"], "rb": ["d", "ic", "rc", "cat"], "pi": ["rb"]}


def oracle(body: str, *using: str) -> str:
    """body with the model's CTEs that it names in `using` before it. body may begin with further CTEs, as `name AS (...), ... SELECT`."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _needs.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for name in using:
        add(name)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    body = body.strip()
    own = not body.upper().startswith("SELECT")
    recursive = "RECURSIVE " if body.upper().startswith("RECURSIVE ") else ""
    body = body[len("RECURSIVE ") :] if recursive else body
    text = (f"WITH {recursive}{head}" + (", " if own else " ") + body) if head else (f"WITH {recursive}{body}" if own else body)
    for k, v in NAMES.items():
        text = text.replace(k, v)
    return text
