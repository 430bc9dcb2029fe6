"""Document fingerprints as Merkle trees, in DataFrame functions only.

A text is cut into leaves (clauses of its lines, so at content-defined places: an edit moves no cut that is not near it). Runs of leaves that end with one whose hash begins with
the digit 0 or 8, one in eight, are sections. A section's hash is that of its leaves' hashes, the root that of the sections'. The fingerprint is
`root:section.section...:leaf.leaf...` in hexadecimal. Equal texts have equal roots; where roots differ, only sections that the other tree lacks need looking into, and the leaves that
differ in them locate the edit (`changed`). Likeness is the weight (in leaves) of what both trees hold over that of what either holds, by distinct leaves.

The next document in ascending doc_id is found inside ranges of doc_id, one shuffle; each range also gets the first document of the next.

Null texts count as empty: n_chars 0, one empty section. Very long texts are cut whole; a run without punctuation is cut every 160 characters. Rows that repeat a doc_id follow one another in
order of their texts. A null doc_id comes first; doc_id is a number. A single document is its own next. Other columns, of any name, are not read. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: A leaf ends after punctuation or a line end and the white space behind it, or after 160 characters.
LEAF = r"[^.,!?;:|\n。、！？]{1,160}+(?:[.,!?;:|。、！？]+[\x20\x09\x0B-\x0D]*|\n)?|[.,!?;:|。、！？]+[\x20\x09\x0B-\x0D]*|\n"


def leaves(text: Column) -> Column:
    """16 hex digits for each leaf."""
    return F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda x: F.right(F.concat(F.lit("000000000000000"), F.hex(F.xxhash64(x))), F.lit(16)))


def fingerprint(text: Column) -> Column:
    # a leaf whose first digit is 0 or 8 ends a section: one in eight
    marked = F.regexp_replace(F.array_join(leaves(text), "."), r"(?<![0-9A-F])([08][0-9A-F]{15})\.", "$1/")
    return F.transform(F.array(marked), lambda m: _tree(m))[0]


def _tree(marked: Column) -> Column:
    sections = F.array_join(F.transform(F.split(marked, "/"), lambda s: F.substring(F.sha2(s, 256), 1, 16)), ".")
    return F.concat(F.sha2(sections, 256), F.lit(":"), sections, F.lit(":"), F.translate(marked, "/", "."))


def part(print_: Column, k: int) -> Column:
    """Root (0), array of sections (1) or of leaves (2)."""
    x = F.split_part(print_, F.lit(":"), F.lit(k + 1))
    return x if k == 0 else F.split(x, r"\.")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else shared over all distinct leaves."""
    both = F.size(F.array_intersect(part(a, 2), part(b, 2)))
    either = F.size(F.array_distinct(part(a, 2))) + F.size(F.array_distinct(part(b, 2))) - both
    return F.when(part(a, 0) == part(b, 0), 1.0).otherwise(both / F.greatest(either, F.lit(1))).cast("double")


def changed(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of a that b lacks: where a was edited; empty for equal roots."""
    where = F.filter(F.transform(part(a, 1), lambda x, i: F.when(F.array_contains(part(b, 1), x), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    return F.when(part(a, 0) == part(b, 0), F.array().cast("array<int>")).otherwise(where)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text (null: empty) and the text of the next document in ascending doc_id, the first after the last."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = d.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / ranges) for k in range(ranges)]), 20 * ranges).alias("c"), F.min("doc_id").alias("m"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("n")).first()
    if cuts.m is None:  # no doc_id at all: texts in order
        cuts_at = []
    else:
        cuts_at = sorted({cuts.m, *cuts.c})
    at = F.lit(0)
    if cuts_at:
        # as many array elements as ranges: the number of cuts that are not above doc_id, by binary steps over the literal array
        bounds = F.array(*map(F.lit, cuts_at))
        at = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(0)) if len(cuts_at) <= 64 else _bucket(F.col("doc_id"), cuts_at)
    rows = d.withColumn("bucket", at.cast("int")).withColumn("guest", F.lit(False))
    # the first document of each range is also the guest at the end of the range before
    first = cuts_at[1:] if not cuts.n else cuts_at
    heads = d.where(F.col("doc_id").isin(first)) if first else d.where("false")
    heads = heads.groupBy("doc_id").agg(F.min("text").alias("text"))
    place = _bucket(F.col("doc_id"), cuts_at) - 1 if cuts_at else F.lit(0)
    # the document before the first cut's range may be in an empty range only if there is no null doc_id
    guests = heads.select("doc_id", "text", place.cast("int").alias("bucket"), F.lit(True).alias("guest"))
    start = d.where(F.col("doc_id").isNull()) if cuts.n else d.where(F.col("doc_id") == F.lit(cuts.m)) if cuts.m is not None else d
    wrap = start.agg(F.min("text").alias("text")).where("text IS NOT NULL").select(F.lit(None).cast(d.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(len(cuts_at)).alias("bucket"), F.lit(True).alias("guest"))
    order = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    own = rows.unionByName(guests).unionByName(wrap)
    return own.withColumn("next", F.lead("text").over(order)).where("NOT guest").select("doc_id", "text", "next")


def _bucket(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not above x, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    below, above = _bucket(x, cuts[:mid]), _bucket(x, cuts[mid + 1 :])
    return F.when(x >= F.lit(cuts[mid]), above + (mid + 1)).otherwise(below)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(table(spark, sf_dir))
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next")).alias("next_fingerprint"))
    f, e, n = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(f, e).alias("near_edited"), likeness(f, n).alias("near_next"), changed(f, e).alias("edited_sections"))
