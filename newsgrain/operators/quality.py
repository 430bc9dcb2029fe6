"""Data quality, integrity and evaluation measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def new_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new whose key existing lacks; repeated keys inside new keep the smallest row."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.distinct()
    return once.join(existing.select(*keys), list(keys), "left_anti")


def idempotent_append(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing and those rows of new whose key it lacks."""
    return existing.unionByName(new_rows(new, existing, keys).select(*existing.columns))


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """updates replace the listed columns of base, and new keys come in."""
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns], F.lit(True).alias("_new"))
    return base.join(u, list(keys), "full").select(*keys, *[F.when(F.col("_new"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns if c not in keys])


def dedupe_exact(df: DataFrame, key: str, order: Sequence) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the others with the reason."""
    r = df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return r.where("_r = 1").drop("_r"), r.where("_r > 1").drop("_r").withColumn("reason", F.lit("duplicate in file"))


def dangling_refs(event_docs: DataFrame, ce: DataFrame, d: DataFrame) -> DataFrame:
    """Counts of mention documents that are missing, masters that point to absent ids, and events without mentions."""
    missing = event_docs.select("doc_id").distinct().join(d.select("doc_id"), "doc_id", "left_anti")
    masters = ce.where("master_event_id IS NOT NULL").select(F.col("master_event_id").alias("id")).join(ce.select("id"), "id", "left_anti")
    silent = ce.select("id").join(event_docs.select(F.col("canonical_event_id").alias("id")), "id", "left_anti")
    out = None
    for name, df in (("missing documents", missing), ("absent masters", masters), ("events without mentions", silent)):
        one = df.agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def metrics(frames: dict[str, DataFrame]) -> DataFrame:
    """(metric, n) of row counts."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def vocabulary_drift(bridge: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    out_of = ~F.col(column).isin(*vocabulary)
    return bridge.agg(F.round(F.count_if(out_of) / F.count("*"), 6).alias("share"), F.count_distinct(F.when(out_of, F.col(column))).alias("distinct_oov"))


def denorm_mismatch(packed: DataFrame, bridge: DataFrame, column: str) -> DataFrame:
    """packed: doc_id, values (array). Documents whose list differs, as a set, from the bridge."""
    b = bridge.groupBy("doc_id").agg(F.array_sort(F.collect_set(column)).alias("b"))
    j = packed.select("doc_id", F.array_sort(F.array_distinct("values")).alias("p")).join(b, "doc_id", "full")
    empty = F.array().cast("array<string>")
    return j.where(F.coalesce("p", empty) != F.coalesce("b", empty)).select("doc_id")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, id_: str, k: int) -> DataFrame:
    """Recall, hit and nDCG at k, and reciprocal rank, for each query of relevant."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hit = ranked.join(relevant, ["query_id", id_])
    g = hit.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = n.join(g, "query_id", "left")
    return j.select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"), F.coalesce(F.col("hits") > 0, F.lit(False)).alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def label_prf(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of (doc_id, label) sets."""
    j = gold.distinct().withColumn("g", F.lit(1)).join(pred.distinct().withColumn("p", F.lit(1)), ["doc_id", "label"], "full")
    c = j.agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))
    p, r = F.col("tp") / F.nullif("n_pred", F.lit(0)), F.col("tp") / F.nullif("n_gold", F.lit(0))
    return c.select("tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * F.col("tp") / F.nullif(F.col("n_pred") + F.col("n_gold"), F.lit(0)), 6).alias("f1"))


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """pairs: x, y."""
    n = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    m = pairs.groupBy(F.col("x").alias("k")).agg(F.count("*").alias("a")).join(pairs.groupBy(F.col("y").alias("k")).agg(F.count("*").alias("b")), "k").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    pe = F.col("ab") / (F.col("n") * F.col("n"))
    return n.crossJoin(m).select(F.round((F.col("same") / F.col("n") - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def cluster_purity(assign: DataFrame) -> DataFrame:
    """assign: cluster, gold."""
    t = assign.groupBy("cluster", "gold").count()
    return t.groupBy("cluster").agg(F.max("count").alias("m"), F.sum("count").alias("n")).agg(F.round(F.sum("m") / F.sum("n"), 6).alias("purity"))


def pairwise_cluster_prf(assign: DataFrame) -> DataFrame:
    """Pair agreement from the contingency table, without making pairs."""
    pairs = lambda keys, name: assign.groupBy(*keys).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias(name))
    j = pairs(["cluster", "gold"], "both").crossJoin(pairs(["cluster"], "pred")).crossJoin(pairs(["gold"], "real"))
    return j.select(F.round(F.col("both") / F.nullif("pred", F.lit(0.0)), 6).alias("precision"), F.round(F.col("both") / F.nullif("real", F.lit(0.0)), 6).alias("recall"), F.round(2 * F.col("both") / F.nullif(F.col("pred") + F.col("real"), F.lit(0.0)), 6).alias("f1"))


def spearman_rank(pairs: DataFrame) -> DataFrame:
    """Rank correlation of id, x, y without ties (ids break them). A rank is the rows with smaller values, summed over the distinct values, plus the place among equal values; no window holds all rows
    but those over distinct values' counts in ranges."""

    def ranked(c: str) -> DataFrame:
        v = pairs.select("id", F.col(c).alias("v"))
        counts = v.groupBy("v").agg(F.count("*").alias("n"))
        # ranges of values in order, the rows before each range, then before each value in it
        r = counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("range"))
        before = r.groupBy("range").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        at = r.withColumn("inside", inside).join(before.select("range", "before"), "range").select("v", (F.col("before") + F.col("inside")).alias("before"))
        return v.join(at, "v").select("id", (F.col("before") + F.row_number().over(W.partitionBy("v").orderBy("id"))).alias(f"r{c}"))

    r = ranked("x").join(ranked("y"), "id").select((F.col("rx") - F.col("ry")).alias("d"))
    n = F.count("*").cast("double")
    return r.agg(F.round(1 - 6 * F.sum((F.col("d") * F.col("d")).cast("double")) / (n * (n * n - 1)), 6).alias("rho"))


def citation_coverage(claims: DataFrame, citations: DataFrame, candidates: DataFrame) -> DataFrame:
    """claims: claim_id. citations: claim_id, doc_id. Share of claims that cite, citations outside the candidates, and the largest share of one document."""
    c = claims.join(citations.select("claim_id").distinct().withColumn("cites", F.lit(True)), "claim_id", "left").agg(F.round(F.count("cites") / F.count("*"), 6).alias("covered"))
    out = citations.join(candidates.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("outside"))
    top = citations.groupBy("doc_id").count().agg(F.round(F.max("count") / F.sum("count"), 6).alias("dominance"))
    return c.crossJoin(out).crossJoin(top)


def stance_tally(rows: DataFrame, known: Sequence[str]) -> DataFrame:
    return rows.groupBy(F.when(F.col("stance").isin(*known), F.col("stance")).otherwise("unclassified").alias("stance")).agg(F.count("*").alias("n"))
