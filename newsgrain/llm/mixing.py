"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

A source's target is water-filled: the share of the demand by weight, stopped at `most` times the source's size, the excess reshared. Source s asks
for its words at the rate target * (1 + tilt * (1 - 2 t)) over training time t in [0, 1]; the integral is the cumulative demand, and inverting it
gives the training position of the word at which a document begins. Documents are taken in whole passes through their source, in an order
hashed from doc_id, the last pass as far as the target goes (to the document whose middle it passes).

Only narrow rows are planned: doc_id, source, a hash of the text and its size. The running sum of sizes in a source goes over ranges of the hashed order, then inside a range, so no source
meets in one task. `placed` joins the plan to the documents once.

Null texts have size 0. A null source is a source of its own, last in order; a null doc_id is ordered like an empty one. Rows that repeat a doc_id are documents of their own, in the order of
their texts' hashes; rows equal in doc_id, source and text follow one another, and which of them comes first is settled by their other columns. Very long texts are counted whole. Equal
hashes of different doc_ids do not occur (md5). Columns of any name are carried untouched. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, saved, table

WEIGHTS = (3, 1, 2)
#: Rows that a range of the hashed order holds on average, at most; a parameter of speed only.
PER_RANGE = 100_000


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size (one row a source). Adds rank (1-based), weight and target; null source last.

    With caps c and weights w, targets are min(c, x * w) for the level x at which they add up to the demand; x is found where sources sorted by c / w stop being capped.
    The windows run over one row a source."""
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", "rank")
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    total, before = W.partitionBy(), by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("demand", F.sum("source_size").over(total) * share)
    s = s.withColumn("level", (F.col("demand") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(total)
    # the first source in ratio order whose level is within its ratio sets the level of all; later ones have the same or a lower level
    s = s.withColumn("level", level)
    return s.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).select("source", "source_size", "rank", "weight", "target")


def _tie() -> Column:
    return F.xxhash64("text")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, tilt: float = 0.5, ranges: int | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): doc_id, source, tie (hash of the text), nth (from 0, among rows equal in these), size, source_size, target, taken (words), copies, and
    position in [0, 1] of the first copy and `again` of the second (null where there is none)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = docs.select("doc_id", "source", _tie().alias("tie"), n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "tie", "size").agg(F.count("*").alias("rows"))
    d = saved(d.withColumn("k", key), "mix")
    if ranges is None:
        ranges = 256
        while ranges < 65536 and d.count() > ranges * PER_RANGE:
            ranges *= 2
    # ranges of k, so the order in a source is that of k whatever their number
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("k", 1, 4), 16, 10).cast("int") * F.lit(ranges) / 65536).cast("int"))
    held = d.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    targets = source_targets(held.groupBy("source").agg(F.sum("n").alias("source_size")), share, most)
    side = held.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before").join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    d = d.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = W.partitionBy("source", "bucket").orderBy("k", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0).cast("long")))
    d = d.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    left = F.col("target") - passes * F.col("source_size")
    d = d.withColumn("copies", passes + F.when((F.col("size") > 0) & (2 * F.col("start") + F.col("size") <= 2 * left), 1).otherwise(0))
    d = d.withColumn("taken", F.col("copies") * F.col("size"))

    def position(at: Column) -> Column:
        """Time t at which target * (t + tilt * t * (1 - t)) reaches at."""
        x = F.least(F.lit(1.0), at / F.greatest(F.col("target"), F.lit(1.0)))
        if not tilt:
            return x
        b = 1 + tilt
        return (b - F.sqrt(b * b - 4 * tilt * x)) / (2 * tilt)

    def lean(at: Column) -> Column:
        """Odd sources come early, even ones late."""
        return F.when(F.col("rank") % 2 == 1, position(at)).otherwise(1 - position(F.col("target") - F.least(at.cast("double"), F.col("target"))))

    d = d.withColumn("position", F.when(F.col("copies") > 0, lean(F.col("start")))).withColumn("again", F.when(F.col("copies") > 1, lean(F.col("start") + F.col("source_size"))))
    return d.select("doc_id", "source", "tie", "nth", "size", "source_size", "target", "taken", "copies", "position", "again")


def placed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents that a plan of mix() takes, once for each copy: struct `row` of their columns, and `position`. The texts are joined to the plan once."""
    # two positions at most for the usual `most` of 2
    at = F.explode(F.when(F.col("copies") > 1, F.array("position", "again")).otherwise(F.array("position"))).alias("position")
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("tie").alias("_t"), "nth", at)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    on = F.col("row.doc_id").eqNullSafe(F.col("_d")) & F.col("row.source").eqNullSafe(F.col("_s")) & (F.col("tie") == F.col("_t"))
    rows = docs.select(every, _tie().alias("tie"))
    repeated = saved(plan.where("nth > 0").select("_d", "_s", "_t").distinct(), "repeated")
    if repeated.isEmpty():
        return rows.join(plan, on).select("row", "position")
    # equal rows are added up before any of them are numbered
    own = W.partitionBy("row.doc_id", "row.source", "tie").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    many = rows.join(repeated, on, "left_semi").groupBy("row", "tie").agg(F.count("*").alias("n")).withColumn("lo", F.coalesce(F.sum("n").over(own), F.lit(0)))
    many = many.join(plan, on & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("lo") + F.col("n"))).select("row", "position")
    return rows.join(repeated, on, "left_anti").join(plan, on).select("row", "position").unionByName(many)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir).select("doc_id", "source", "text"))
    m = m.select("doc_id", "size", "source_size", "target", "taken", "position")
    return m.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio, (SELECT sum(source_size) FROM s0) * 1.5::DOUBLE AS demand FROM s2),
s4 AS (SELECT *, (demand - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s3),
s5 AS (SELECT *, (SELECT max(lev) FROM s4 WHERE lev <= ratio) AS level FROM s4),
t AS (SELECT source, rank, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM s5),
o AS (SELECT d.doc_id, d.size, t.rank, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1)) AS passes,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(passes + CASE WHEN size > 0 AND 2 * start + size <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN CASE WHEN rank % 2 = 1 THEN 1.5::DOUBLE - sqrt(2.25::DOUBLE - 2.0::DOUBLE * least(1.0::DOUBLE, start / greatest(target, 1.0::DOUBLE)))
    ELSE 1 - (1.5::DOUBLE - sqrt(2.25::DOUBLE - 2.0::DOUBLE * least(1.0::DOUBLE, (target - least(CAST(start AS DOUBLE), target)) / greatest(target, 1.0::DOUBLE)))) END END AS position
FROM c
"""
