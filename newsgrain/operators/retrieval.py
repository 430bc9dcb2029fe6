"""Batch keyword, vector and hybrid retrieval over query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import new_dir, written
from .tiles import nearest
from .vector_index import VectorIndex


def tokens(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def build_postings(d: DataFrame, id_: str, fields: dict[str, str]) -> DataFrame:
    """term, id, field, tf; plain lower-case tokens, no stemming."""
    out = None
    for column, label in fields.items():
        one = d.select(F.col(id_), F.lit(label).alias("field"), F.explode(tokens(F.col(column))).alias("term"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("term", id_, "field").agg(F.count("*").alias("tf"))


def keyword_search(queries: DataFrame, postings: DataFrame, sizes: DataFrame, k: int, id_: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """All terms of a query must match; BM25. Candidates are the postings of a query's rarest term. queries: query_id, query. sizes: id, n_tokens.

    Texts of the same bag of terms score alike, as do queries of the same terms: one of each is scored, and a text's first k copies come in for the k best."""
    said = queries.select("query_id", F.array_sort(F.array_distinct(tokens(F.col("query")))).alias("said")).where(F.size("said") > 0)
    asked_by = said.withColumn("_asks", F.min("query_id").over(W.partitionBy("said")))
    terms = asked_by.where("query_id = _asks").select("query_id", F.explode("said").alias("term"))
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    tf = postings.groupBy("term", id_).agg(F.sum("tf").alias("tf"))
    bags = tf.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("bag")).join(sizes, id_)
    first = W.partitionBy("n_tokens", "bag")
    copies, _ = written(bags.withColumns({"_class": F.min(id_).over(first), "_copies": F.count("*").over(first), "_r": F.row_number().over(first.orderBy(id_))}).where(F.col("_r") <= k), "copies")
    one_each = copies.where(F.col(id_) == F.col("_class"))
    tf = one_each.select(id_, "n_tokens", "_copies", F.explode("bag").alias("b")).select(id_, "n_tokens", "_copies", "b.term", "b.tf")
    asked = terms.join(tf.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("_copies").alias("df")), "term", "left").select("query_id", "term", F.coalesce("df", F.lit(0)).alias("df"))
    rare = asked.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("r")).select("query_id", F.col("r.term").alias("term"))
    total = sizes.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"))
    hit = tf.select("term", id_).join(rare, "term").select("query_id", id_).join(asked, "query_id").join(tf, ["term", id_]).crossJoin(F.broadcast(total))  # one row
    one = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean")))
    g = hit.groupBy("query_id", id_).agg(F.round(F.sum(one), 6).alias("score"), F.count("*").alias("matched")).join(need, "query_id").where("matched = need")
    best = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_))).where(F.col("rank") <= k)
    # the k best have k classes at most
    g = best(g).select("query_id", F.col(id_).alias("_class"), "score").join(copies.select("_class", id_), "_class")
    g = best(g.select("query_id", id_, "score"))
    return g.withColumnRenamed("query_id", "_asks").join(asked_by.select("_asks", "query_id"), "_asks").select("query_id", id_, "score", "rank")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, filters: Column | str | None = None, approx: bool = False, index: VectorIndex | None = None) -> DataFrame:
    """Cosine top k of every query vector (query_id, q) among those of vectors (vec_id, embedding and what filters name) that pass the filters; the query set is stated by the caller. Exact, tile by tile;
    with approx by an inverted index (the given one, else one made for the call), which reads few cells and gives as many rows."""
    if approx:
        return (index or VectorIndex.build(vectors, new_dir(vectors.sparkSession, "vector-index"))).search(queries, k, filters)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return nearest(queries, vectors if filters is None else vectors.where(filters), k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_rrf(vector: DataFrame, keyword: DataFrame, id_: str, full_outer: bool = False) -> DataFrame:
    """0.7 / (60 + vector rank) + 0.3 / (60 + keyword rank), from the vector candidates (or from both)."""
    v, b = vector.select("query_id", id_, F.col("rank").alias("v")), keyword.select("query_id", id_, F.col("rank").alias("b"))
    part = lambda w, c: F.coalesce(w / (60 + F.col(c)), F.lit(0.0))
    return v.join(b, ["query_id", id_], "full" if full_outer else "left").select("query_id", id_, F.round(part(0.7, "v") + part(0.3, "b"), 6).alias("rrf_score"))


def rerank_fusion(ranked: DataFrame, id_: str, alpha: float = 0.6, lowest: int = 3) -> DataFrame:
    """ranked: query_id, id, rank (retrieval), rerank_score. Fused order; the retrieval's first never falls below place `lowest`."""
    by = lambda *o: F.row_number().over(W.partitionBy("query_id").orderBy(*o))
    r = ranked.withColumn("rr", by(F.desc("rerank_score"), id_))
    r = r.withColumn("fused", F.round(alpha / (60 + F.col("rr")) + (1 - alpha) / (60 + F.col("rank")), 9)).withColumn("place", by(F.desc("fused"), id_))
    first = F.col("rank") == 1
    pinned = F.max(F.when(first & (F.col("place") > lowest), F.col("place"))).over(W.partitionBy("query_id"))
    r = r.withColumn("pinned", pinned)
    place = F.when(F.col("pinned").isNull(), F.col("place")).when(first, F.lit(lowest)).when((F.col("place") >= lowest) & (F.col("place") < F.col("pinned")), F.col("place") + 1).otherwise(F.col("place"))
    return r.select("query_id", id_, "fused", place.cast("int").alias("place"))


def entity_boost(results: DataFrame, docs: DataFrame, id_: str, by: float = 0.15) -> DataFrame:
    """Score raised for the documents of matched entities, capped at 1. docs: id, and query_id where the matches are those of a query."""
    on = ["query_id", id_] if "query_id" in docs.columns else [id_]
    j = results.join(docs.select(*on).distinct().withColumn("hit", F.lit(True)), on, "left")
    return j.select("query_id", id_, F.round(F.when(F.col("hit"), F.least(F.col("score") + by, F.lit(1.0))).otherwise(F.col("score")), 6).alias("score"))
