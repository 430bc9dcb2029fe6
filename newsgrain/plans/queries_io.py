"""Queries of readers, writers and file streams: files in the reference's formats are made from the given tables, in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.store import new_dir
from ..sources import label_records, readers, writers
from ..streaming import jobs
from .model import Model
from .registry import query


def csv(df, m: Model, label: str) -> str:
    where = new_dir(m.spark, label)
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(where)
    return where


@query("read_articles_csv", """k AS (SELECT * FROM d WHERE doc_id % 7 <> 0 AND doc_id % 2 = 0),
u AS (SELECT doc_id, concat('T', doc_id) AS title, concat(distilled_text, ' and \"more\"') AS body, source_name, date
  FROM k) SELECT CAST(doc_id AS VARCHAR) AS doc_id, title, body, source_name, date, 'even' AS collection
FROM u""", "d")
def read_articles_csv(m: Model):
    """Two collections, bodies of two lines with quotes, a seventh without a body, every row twice."""
    i = F.col("doc_id")
    body = F.when(i % 7 != 0, F.concat("distilled_text", F.lit('\n\nand "more"')))
    day = F.when(i % 3 == 0, F.date_format("date", "MM/dd/yyyy")).otherwise(F.col("date").cast("string"))
    rows = m.d.select(i.alias("ATOM ID"), F.concat(F.lit("T"), i.cast("string")).alias("Title"), body.alias("Body"), F.col("source_name").alias("Source Name"), day.alias("Source Date, Start"), F.when(i % 2 == 0, "even").otherwise("odd").alias("Collection Name"))
    return readers.read_articles_csv(m.spark, csv(rows.unionByName(rows), m, "articles"), "even")


OK = "doc_id", "title", "source_name", "source_geofocus", "source_location", "date", "salience", "salience_justification", "category", "initiating_country", "event_name", "projects"


def with_rejects(both):
    """Some fields of documents and, beside them, the rejects with their reasons."""
    ok, bad = both
    return ok.select(*OK, F.lit(None).cast("string").alias("reason")).unionByName(bad, allowMissingColumns=True)


@query("read_packed_labels_csv", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, concat('T', doc_id) AS title, source_name, source_geofocus, CASE WHEN doc_id % 3 = 0 THEN 'somewhere' ELSE 'None Specified' END AS source_location, date, 'true' AS salience, CASE WHEN doc_id % 2 = 0 THEN 'because' END AS salience_justification, source_name AS category, CAST(NULL AS VARCHAR) AS initiating_country, CASE WHEN medium = 'P' THEN CASE WHEN doc_id % 2 = 0 THEN 'a project' END ELSE title END AS event_name, CASE WHEN doc_id % 2 = 0 THEN 'a project' END AS projects, CAST(NULL AS VARCHAR) AS reason
FROM d WHERE doc_id % 5 > 1 UNION ALL SELECT CASE WHEN doc_id % 15 <> 1 THEN CAST(doc_id AS VARCHAR) END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 15 = 1 THEN 'missing ATOM ID' WHEN doc_id % 5 = 0 THEN 'token mismatch' ELSE 'no extraction pass' END
FROM d WHERE doc_id % 5 < 2 UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'duplicate doc_id within file'
FROM d WHERE doc_id % 35 = 2""", "d")
def read_packed_labels_csv(m: Model):
    """A fifth of the rows with a value too few, a fifth without an extraction pass, some without an id or twice in a file; categories twice, of which the later counts, labels of a later pass that don't, missing
    events as N/A, and a justification before the pass in every second row."""
    i = F.col("doc_id")
    because = i % 2 == 0
    head = F.when(because, "salience | salience-justification | salience-bool").otherwise("salience | x | salience-bool")
    types = F.when(i % 5 == 1, "category | event-name").otherwise(F.concat(head, F.lit(" | category | event-name | category | "), F.when(because, "projects").otherwise("location"), F.lit(" | tisc_pass | initiating-country")))
    event = F.when(F.col("medium") == "P", "N/A").otherwise(F.col("title"))
    values = F.when(i % 5 == 0, "true | because | TRUE").when(i % 5 == 1, F.concat_ws(" | ", "source_name", event)).otherwise(F.concat_ws(" | ", F.lit("true | because | TRUE"), F.lit("early"), event, "source_name", F.lit("a project | later | Nowhere")))
    rows = m.d.select(F.when(i % 15 != 1, i).alias("ATOM ID"), F.concat(F.lit("T"), i.cast("string")).alias("Title"), F.col("source_name").alias("Source Name"), F.col("date").alias("Source Date, Start"), F.col("source_geofocus").alias("Source Geofocus Country"), F.when(i % 3 == 0, "somewhere").otherwise("nan").alias("Source Country, Physical"), types.alias("Auto GAI, Value Type"), values.alias("Auto GAI, Value"))
    # an export a task; a document that comes twice does so in one export
    rows = rows.withColumn("n", F.explode(F.when(F.col("ATOM ID") % 35 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n")
    return with_rejects(label_records.read_packed_labels_csv(m.spark, csv(rows, m, "labels")))


@query("read_label_json", """SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'Default Title' ELSE title END AS title, source_name, source_geofocus, 'None Specified' AS source_location, date, CAST(NULL AS VARCHAR) AS salience, CAST(NULL AS VARCHAR) AS salience_justification, source_name AS category, ic.initiating_country, CASE WHEN d.doc_id % 3 = 0 THEN 'a project' ELSE 'an event' END AS event_name, CAST(NULL AS VARCHAR) AS projects, CAST(NULL AS VARCHAR) AS reason
FROM d JOIN ic ON ic.doc_id = d.doc_id WHERE d.doc_id % 6 <> 5 UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing auto.gai analysis block'
FROM d WHERE doc_id % 6 = 5 UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'duplicate doc_id within file' FROM d WHERE doc_id % 30 = 1""", "d")
def read_label_json(m: Model):
    """Files of a few hundred nested records each, a third of them lists, a third lists of lists, the rest of one record a line: a quarter without a title, a third with a project in place of an event,
    a sixth with one pass only, some twice, and each with two categories, of which the later counts."""
    i = F.col("doc_id")
    pair = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    labels = F.array(pair("category", F.lit("early")), pair("initiating-country", F.col("initiating_country")), pair("event-name", F.when(i % 3 == 0, "N/A").otherwise("an event")), pair("project-name", F.lit("a project")), pair("category", F.col("source_name")))
    by = F.struct(F.lit("p").alias("identifier"), F.lit("1").alias("version"))
    one = lambda version, values: F.struct(F.lit(version).alias("modelVersion"), by.alias("filter"), values.alias("value"))
    full, none = one("2", labels), one("1", F.array().cast("array<struct<type:string,value:string>>"))
    source = F.struct(F.struct(F.col("source_name").alias("transliterated")).alias("name"), F.col("source_geofocus").alias("geofocusCountry"), F.col("date").cast("string").alias("startDate"))
    atom = F.struct(F.struct(F.lit("c").alias("collection_name")).alias("atom"))
    record = F.struct(i.cast("string").alias("id"), F.struct(F.when(i % 4 != 0, F.col("title")).alias("title")).alias("title"), source.alias("source"), atom.alias("custom"), F.struct(F.when(i % 6 == 5, F.array(full)).otherwise(F.array(none, full)).alias("gai")).alias("auto"))
    rows = m.d.join(m.ic, "doc_id").select((F.col("doc_id") % 3).alias("kind"), F.floor(i / 1000).alias("file"), F.to_json(record).alias("value"), F.explode(F.when(i % 30 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
    lists, lines = new_dir(m.spark, "records"), new_dir(m.spark, "record-lines")
    comma = lambda c: F.array_join(F.collect_list(c), ",\n")
    inner = rows.where("kind < 2").groupBy("kind", "file", F.when(F.col("kind") == 0, F.lit(0)).otherwise(F.crc32(F.split_part("value", F.lit(","), F.lit(1))) % 5).alias("part")).agg(comma("value").alias("value"))
    whole = inner.groupBy("kind", "file").agg(comma(F.when(F.col("kind") == 0, F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))).alias("value"))
    whole.select(F.concat(F.lit("["), "value", F.lit("]"))).write.option("maxRecordsPerFile", 1).text(lists)
    rows.where("kind = 2").select("value").repartition(4, "value").write.text(lines)
    return with_rejects(label_records.read_label_json(m.spark, lists)).unionByName(with_rejects(label_records.read_label_json(m.spark, lines, lines=True)))


@query("read_finance_projects", """SELECT CAST(p_partkey AS VARCHAR) AS project_id, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 5 <> 0 THEN CAST(1990 + p_partkey % 30 AS INT) END AS commitment_year, p_retailprice AS amount, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS recommended, DATE '2019-01-01' + CAST(p_partkey % 300 AS INT) AS start_date
FROM part""")
def read_finance_projects(m: Model):
    return readers.read_finance_projects(m.spark, projects(m))


def projects(m: Model) -> str:
    k = F.col("p_partkey")
    year = F.when(k % 5 != 0, F.concat((1990 + k % 30).cast("string"), F.lit(".0"))).otherwise("unknown")
    rows = m.table("part").select(F.concat(F.lit(" "), k.cast("string")).alias("Project ID"), F.when(k % 9 != 0, F.col("p_name")).otherwise("N/A").alias("Title"), year.alias("Commitment Year"), F.col("p_retailprice").cast("string").alias("Amount"), F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("").alias("Recommended For Aggregates"), F.date_format(F.date_add(F.lit("2019-01-01").cast("date"), (k % 300).cast("int")), "M/d/yyyy").alias("Start Date"))
    return csv(rows, m, "projects")


@query("read_finance_locations", "SELECT CAST(l_partkey AS VARCHAR) AS project_id, l_returnflag AS adm1, l_linestatus AS adm2 FROM lineitem WHERE l_partkey % 4 <> 0")
def read_finance_locations(m: Model):
    """Places of projects that are not there are left out."""
    rows = m.table("lineitem").select(F.col("l_partkey").alias("Project ID"), F.col("l_returnflag").alias("ADM1"), F.col("l_linestatus").alias("ADM2"))
    known = readers.read_finance_projects(m.spark, projects(m)).where("project_id % 4 <> 0")
    return readers.read_finance_locations(m.spark, csv(rows, m, "places"), known)


@query("read_embeddings_parquet", """SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
FROM embeddings WHERE vec_id % 3 <> 0""")
def read_embeddings_parquet(m: Model):
    """Vectors as text, ids in JSON, a third loaded before."""
    where = new_dir(m.spark, "dump")
    m.vectors.select(F.to_json(F.struct(F.col("vec_id").cast("string").alias("doc_id"))).alias("metadata"), F.to_json("embedding").alias("embedding")).write.parquet(where)
    d = readers.read_embeddings_parquet(m.spark, where, m.vectors.where("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("doc_id")))
    return d.select("doc_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("write_partitioned_export", "SELECT source_name, count(*) AS rows, count(*) AS counted FROM d GROUP BY 1", "d")
def write_partitioned_export(m: Model):
    """The manifest beside the rows that the partitions hold."""
    where = new_dir(m.spark, "export")
    writers.write_partitioned_export(m.d.select("doc_id", "title", "source_name"), where, ["source_name"])
    held = m.spark.read.parquet(f"{where}/data").groupBy("source_name").agg(F.count("*").alias("counted"))
    return m.spark.read.schema("source_name string, rows long").json(f"{where}/manifest").join(held, "source_name")


@query("write_chart_csv", "SELECT source_name, count(*) AS n FROM d GROUP BY 1", "d")
def write_chart_csv(m: Model):
    where = new_dir(m.spark, "chart")
    writers.write_chart_csv(m.d.groupBy("source_name").agg(F.count("*").alias("n")), where, ["source_name"])
    return m.spark.read.option("header", True).schema("source_name string, n long").csv(where)


@query("stream_ingest_files", "SELECT doc_id, category AS label FROM cat", "cat")
def stream_ingest_files(m: Model):
    """Four files, one a trigger, and all documents again in a second run, a month later and under other labels, which takes nothing twice."""
    source, at = new_dir(m.spark, "incoming"), new_dir(m.spark, "taken-checkpoint")
    sink = jobs.LedgerSink(m.spark, new_dir(m.spark, "taken"), "doc_id long, label string")
    rows = m.cat.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("category")), "; ").alias("labels")).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.repartition(4, "doc_id").write.parquet(source)
    held = m.spark.read.schema(rows.schema).parquet(source)  # the four files
    again = held.select("doc_id", F.concat("labels", F.lit("; late")).alias("labels"), F.lit("2024-02-01").cast("timestamp").alias("ts"))
    jobs.stream_ingest_files(m.spark, source, rows.schema, sink, at).awaitTermination()
    again.coalesce(1).write.mode("append").parquet(source)
    jobs.stream_ingest_files(m.spark, source, rows.schema, sink, at).awaitTermination()
    return sink.read()
