"""Label records: documents with the labels that an extraction pass gave them, from nested JSON or from exports that pack labels into two columns.

Both forms become rows of document fields and an array of (type, value) labels; `documents` turns these into one column for each field. A label that comes again replaces the one before it, a label named
like a document field replaces that field, and what cannot be read is kept with the reason instead of ending the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.store import written

# The labels of an extraction pass, in export order
EXTRACTION = ("salience-justification", "salience-bool", "category", "category-justification", "subcategory", "initiating-country", "recipient-country", "projects", "lat-long", "location", "monetary-commitment", "distilled-text", "event-name")
# What a document has beside its labels
FIELDS = ("title", "source_name", "source_geofocus", "source_description", "source_medium", "source_location", "source_editorial", "source_consumption", "collection_name", "gai_engine", "gai_promptid", "gai_promptversion")
# Labels that are columns of a document, beside those of events and projects
LABELS = ("salience", "salience_justification", "salience_bool", "category", "category_justification", "subcategory", "initiating_country", "recipient_country", "lat_long", "location", "monetary_commitment", "distilled_text")
NO_TITLE, NO_PLACE = "Default Title", "None Specified"
PAIRS = "array<struct<type:string,value:string>>"


def label_files(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, at, record: the JSON text of each record and its place in its file. A file holds one record, a list of records, or a list of lists of records; with lines, each line is a record.

    A file without lines is one row until its records are taken apart, so large exports should have lines."""
    text = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("value"))
    if lines:
        return text.where("value <> ''").select("file", F.struct("block", F.monotonically_increasing_id().alias("n")).alias("at"), F.col("value").alias("record"))
    listed = F.from_json("value", "array<string>")
    nested = F.size("l") > 0, F.forall("l", lambda x: F.coalesce(x.startswith("["), F.lit(False)))
    inner = F.flatten(F.transform("l", lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array(x))))
    # what is no list is one record; whether it can be read is judged later
    each = text.withColumn("l", listed).select("file", "block", F.when(F.col("l").isNull(), F.array("value")).when(nested[0] & nested[1], inner).otherwise(F.col("l")).alias("records"))
    # an inner explode makes Spark look for empty lists first, by a filter that parses each file once for every mention of the list
    taken = each.select("file", "block", F.posexplode_outer("records").alias("n", "record")).where("n IS NOT NULL")
    return taken.select("file", F.struct("block", F.col("n").cast("long").alias("n")).alias("at"), "record")


def key(of: str, name: str) -> Column:
    """Value of a key of a map column; the last where the JSON object repeats it."""
    return F.try_element_at(F.map_values(F.map_filter(F.col(of), lambda k, _: k == name)), F.lit(-1))


def has(of: str, name: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col(of), name), F.lit(False))


def parsed_json(records: DataFrame) -> DataFrame:
    """Document fields, pairs and reason of JSON records (file, at, record)."""
    inside = lambda of, name, kind="map<string,string>": F.from_json(key(of, name), kind)
    d = records.withColumn("r", F.from_json("record", "map<string,string>"))
    d = d.withColumns({"auto": inside("r", "auto"), "source": inside("r", "source"), "custom": inside("r", "custom"), "titles": inside("r", "title"), "translations": inside("r", "machineTranslations")})
    d = d.withColumns({"gai": inside("auto", "gai", "array<string>"), "name": inside("source", "name"), "country": inside("source", "country"), "atom": inside("custom", "atom"), "translated": inside("translations", "title_title")})
    d = d.withColumn("pass", F.from_json(F.get("gai", F.lit(1)), "map<string,string>")).withColumns({"filter": inside("pass", "filter"), "pairs": inside("pass", "value", PAIRS)})
    translated = key("translated", "text")
    needed = {"id": has("r", "id"), "source.name.transliterated": has("name", "transliterated"), "source.startDate": key("source", "startDate").isNotNull(), "custom.atom.collection_name": has("atom", "collection_name"), "modelVersion": has("pass", "modelVersion"), "filter.identifier": has("filter", "identifier"), "filter.version": has("filter", "version")}
    reason = F.when(F.col("r").isNull(), "not an object").when(F.coalesce(F.size("gai"), F.lit(0)) < 2, "missing auto.gai analysis block")
    for what, there in needed.items():
        reason = reason.when(~there, f"missing {what}")
    place = lambda name: F.when(has("country", name), key("country", name)).otherwise(NO_PLACE)
    return d.select(
        "file", "at", key("r", "id").alias("doc_id"), F.when(F.length(translated) > 0, translated).when(has("titles", "title"), key("titles", "title")).otherwise(NO_TITLE).alias("title"),
        key("name", "transliterated").alias("source_name"), key("source", "geofocusCountry").alias("source_geofocus"), key("source", "descriptor").alias("source_description"), key("source", "medium").alias("source_medium"),
        place("physical").alias("source_location"), place("editorial").alias("source_editorial"), place("consumption").alias("source_consumption"), key("source", "startDate").alias("start"),
        key("atom", "collection_name").alias("collection_name"), key("pass", "modelVersion").alias("gai_engine"), key("filter", "identifier").alias("gai_promptid"), key("filter", "version").alias("gai_promptversion"), "pairs", reason.alias("reason"),
    )


def tokens(c: Column) -> Column:
    """Parts between ` | `, trimmed; none for null, blank or nan."""
    t = F.trim(c)
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "nan"), F.array().cast("array<string>")).otherwise(F.transform(F.split(c, r" \| "), lambda x: F.trim(x)))


def packed_pairs(types: Column, values: Column) -> tuple[Column, Column]:
    """The pairs of the extraction pass, and why there are none. The pass begins at salience-bool, or at its justification just before, and ends at the first label that is not of it; the value of the
    salience filter comes last."""
    anchor = F.array_position(types, F.lit("salience-bool"))
    reason = F.when(F.size(types) != F.size(values), "token mismatch").when(anchor == 0, "no extraction pass")
    first = F.when((anchor > 1) & (F.get(types, (anchor - 2).cast("int")) == "salience-justification"), anchor - 1).otherwise(F.greatest(anchor, F.lit(1))).cast("int")
    both = F.slice(F.arrays_zip(types.alias("type"), values.alias("value")), first, F.greatest(F.size(types), F.lit(1)))
    stop = F.array_position(F.transform(both, lambda p: p["type"].isin(*EXTRACTION)), F.lit(False)).cast("int")
    own = F.when(stop == 0, both).otherwise(F.slice(both, 1, F.greatest(stop - 1, F.lit(0))))
    at = F.array_position(types, F.lit("salience"))
    filtered = F.when(at > 0, F.array(F.struct(F.lit("salience").alias("type"), F.get(values, (at - 1).cast("int")).alias("value")))).otherwise(F.array().cast(PAIRS))
    return F.when(reason.isNull(), F.concat(own.cast(PAIRS), filtered.cast(PAIRS))), reason


def parsed_csv(rows: DataFrame) -> DataFrame:
    """Document fields, pairs and reason of rows of a packed export (its columns in lower case, and file and at)."""
    def clean(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("string")
        t = F.trim(F.col(f"`{name}`"))
        return F.when((t != "") & (F.lower(t) != "nan"), t)

    raw = lambda name: F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")
    second = lambda name: F.coalesce(F.get(tokens(raw(name)), F.lit(1)), F.get(tokens(raw(name)), F.lit(0)))
    d = rows.withColumns({"_t": tokens(raw("auto gai, value type")), "_v": tokens(raw("auto gai, value"))})
    pairs, reason = packed_pairs(F.col("_t"), F.col("_v"))
    reason = F.when(clean("atom id").isNull(), "missing ATOM ID").when(clean("source date, start").isNull(), "missing Source Date, Start").otherwise(reason)
    place = lambda name: F.coalesce(clean(f"source country, {name}"), F.lit(NO_PLACE))
    return d.select(
        "file", "at", clean("atom id").alias("doc_id"), F.coalesce(clean("machine translations, title, text"), clean("title"), F.lit(NO_TITLE)).alias("title"),
        clean("source name").alias("source_name"), clean("source geofocus country").alias("source_geofocus"), clean("source descriptor").alias("source_description"), clean("source medium").alias("source_medium"),
        place("physical").alias("source_location"), place("editorial").alias("source_editorial"), place("consumption").alias("source_consumption"), clean("source date, start").alias("start"),
        clean("collection name").alias("collection_name"), second("auto gai, model version").alias("gai_engine"), second("auto gai, prompt identifier").alias("gai_promptid"), second("auto gai, prompt version").alias("gai_promptversion"), pairs.alias("pairs"), reason.alias("reason"),
    )


def documents(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a column for each field and label, and the rejected records (doc_id, reason). Of records of a file that repeat a doc_id the first that can be read stays."""
    d = parsed.withColumn("date", C.parse_flexible_date(F.col("start")))
    untyped = F.exists(F.coalesce("pairs", F.array().cast(PAIRS)), lambda p: p["type"].isNull())
    d = d.withColumn("reason", F.coalesce("reason", F.when(F.col("date").isNull(), "unreadable date").when(untyped, "label without a type")))
    turn = F.row_number().over(W.partitionBy("file", "doc_id", "reason").orderBy("at"))
    d = d.withColumn("turn", turn).drop("file", "at", "start")
    # documents and both kinds of rejects ask it, so files are read and parsed once
    d, _ = written(d, "label-records")
    read = d.where("reason IS NULL")
    named = F.transform("pairs", lambda p: F.struct(F.replace(p["type"], F.lit("-"), F.lit("_")).alias("name"), p["type"].alias("type"), C.normalize_na(p["value"]).alias("value")))
    ok = read.where("turn = 1").withColumn("pairs", F.reverse(F.coalesce(named, F.array().cast("array<struct<name:string,type:string,value:string>>"))))
    events = ("event-name", "project-name", "projects")
    # names and values from the last to the first, so that the first place of a name is its last label
    own, other = F.filter("pairs", lambda p: ~p["type"].isin(*events)), F.filter("pairs", lambda p: p["type"].isin(*events))
    ok = ok.withColumns({"_own": own, "_other": other}).drop("pairs")
    ok = ok.withColumns({"_names": F.transform("_own", lambda p: p["name"]), "_values": F.transform("_own", lambda p: p["value"]), "_types": F.transform("_other", lambda p: p["type"]), "_events": F.transform("_other", lambda p: p["value"])})

    def last(name: str, names: str = "_names", values: str = "_values") -> Column:
        """The value of the last label of a name; null if there is none."""
        at = F.array_position(names, F.lit(name))
        return F.when(at > 0, F.get(values, (at - 1).cast("int")))

    field = lambda name: F.when(F.array_position("_names", F.lit(name)) > 0, last(name)).otherwise(F.col(name)).alias(name)
    event = {t: last(t, "_types", "_events") for t in events}
    out = ok.select("doc_id", "date", *map(field, FIELDS), *[last(name).alias(name) for name in LABELS], F.coalesce(*event.values()).alias("event_name"), event["project-name"].alias("project_name"), event["projects"].alias("projects"))
    again = read.where("turn > 1").select("doc_id", F.lit("duplicate doc_id within file").alias("reason"))
    return out, d.where("reason IS NOT NULL").select("doc_id", "reason").unionByName(again)


def read_label_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and rejects of nested label records, whose second pass holds the labels."""
    return documents(parsed_json(label_files(spark, path, lines)))


def read_packed_labels(df: DataFrame, types: str = "types", values: str = "values") -> tuple[DataFrame, DataFrame]:
    """Two ` | `-joined parallel columns -> one column for each label; rows without an extraction pass are rejected with the reason."""
    pairs, reason = packed_pairs(F.col("_t"), F.col("_v"))
    d = df.withColumns({"_t": tokens(F.col(types)), "_v": tokens(F.col(values))}).withColumns({"_pairs": pairs, "reason": reason})
    last = lambda name: C.normalize_na(F.try_element_at(F.filter("_pairs", lambda p: p["type"] == name), F.lit(-1))["value"])
    labels = [last(name).alias(name.replace("-", "_")) for name in (*EXTRACTION, "salience")]
    return d.where("reason IS NULL").select(*df.columns, *labels), d.where("reason IS NOT NULL").select(*df.columns, "reason")


def read_packed_labels_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and rejects of a packed export: CSV with a header, quoted fields that may hold line ends, lines that do not parse left out."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.toDF(*[c.lstrip("﻿").strip().strip('"').lower() for c in raw.columns])
    at = F.struct(F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("n"))
    return documents(parsed_csv(rows.select("*", F.input_file_name().alias("file"), at.alias("at"))))
