"""Entities, co-occurrence, components, clustering over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import forget, written
from .tiles import TILE, least_links, similar_pairs, unit

__all__ = ["similar_pairs"]


def entity_pairs(e: DataFrame, tile: int) -> DataFrame:
    """initiating_country, a, b, doc_id for each pair a < b of a document's entities (initiating_country, entity, doc_id, distinct). A document of n entities is dealt as a triangle of n / tile tiles a
    side, so that no join key has more than about a tile of rows on a side."""
    own = ["initiating_country", "doc_id"]
    many = F.ceil(F.count("*") / tile).cast("int")
    large = e.groupBy(*own).agg(many.alias("_t")).where("_t > 1")
    d = e.join(large, own, "left").withColumn("_t", F.coalesce("_t", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("entity"), F.col("_t")).cast("int"))
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).withColumns({"_i": F.least("_own", "_k"), "_j": F.greatest("_own", "_k")})
    side = lambda n: d.select(*own, "_i", "_j", "_own", F.col("entity").alias(n))
    left, right = side("a"), side("b").withColumnRenamed("_own", "_other")
    j = left.join(right, [*own, "_i", "_j"]).where("a < b")
    # entities of one tile meet wherever the tile goes; they count in its own corner only
    return j.where("_own <> _other OR (_i = _own AND _j = _own)").select("initiating_country", "a", "b", "doc_id")


def entity_weights(den: DataFrame, least: int = 2, tile: int = 256) -> DataFrame:
    """initiating_country, a, b, weight: the edges of entity_cooccurrence without what is told about their documents. Pairs are counted before the shuffle, and shuffled once."""
    e = den.select("initiating_country", "entity", "doc_id").distinct()
    return entity_pairs(e, tile).groupBy("initiating_country", "a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def entity_cooccurrence(den: DataFrame, d: DataFrame, cat: DataFrame, least: int = 2, most_docs: int = 100, most_entities: int | None = None, tile: int = 256) -> DataFrame:
    """Per country, pairs of entities (a < b) with at least `least` shared documents: weight, up to most_docs document ids (the smallest), and from these the first and last day and a count map by category.
    den: initiating_country, entity, doc_id of master entities. most_entities leaves out documents with more entities than that; none are left out by default. Weights are counted before the shuffle, and
    of a pair's documents each task sends on most_docs at most."""
    e = den.select("initiating_country", "entity", "doc_id").distinct()
    if most_entities:
        e = e.join(e.groupBy("initiating_country", "doc_id").count().where(F.col("count") <= most_entities).drop("count"), ["initiating_country", "doc_id"], "left_semi")
    key = ["initiating_country", "a", "b"]
    p = entity_pairs(e, tile)
    weights = p.groupBy(*key).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    smallest = p.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("doc_id"))).where(F.col("_r") <= most_docs).drop("_r")
    shown = smallest.join(weights, key)
    g = shown.groupBy(*key, "weight").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    days = shown.join(d.select("doc_id", "date"), "doc_id").groupBy(*key).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    cats = shown.join(cat, "doc_id").groupBy(*key, "category").agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    return g.join(days, key).join(cats, key, "left")


def graph_degree(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "weight").unionByName(edges.select(F.col("b").alias("a"), "weight"))
    return both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum(F.coalesce("weight", F.lit(1))).alias("weighted"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node). Minima spread along edges and jump along labels; each round is written to the shared folder, and the round before is deleted."""
    spark = edges.sparkSession
    sym, kept = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, at = written(sym.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = sym.join(labels, sym.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "m").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new, now = written(step.join(jump, "component").select("node", F.least("component", "further").alias("component"), "before"), "labels")
        forget(spark, at)
        at, labels = now, new.select("node", "component")
        if new.where("component <> before").isEmpty():
            forget(spark, kept)
            return labels


def entity_neighbors(edges: DataFrame, root: str, hops: int = 2, strongest: int = 200, least: int = 1) -> DataFrame:
    """Nodes within some hops of root, each at its shallowest; per hop only the strongest edges of the frontier (of weight `least` at least) are followed, as the feature has it."""
    edges, _ = written(edges.where(F.col("weight") >= least).select("a", "b", "weight"), "graph")  # every hop asks it again
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    seen = edges.sparkSession.createDataFrame([(root, 0)], "node string, hop int")
    frontier = seen.select("node")
    for hop in range(1, hops + 1):
        out = both.join(F.broadcast(frontier), both.a == frontier.node, "left_semi").orderBy(F.desc("weight"), "a", "b").limit(strongest)  # at most `strongest` nodes
        frontier = out.select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(frontier.select("node", F.lit(hop).alias("hop")))
    return seen


def ego_subgraph_betweenness(edges: DataFrame, actor: str, top: int = 40) -> DataFrame:
    """Betweenness in each actor's subgraph of its `top` nodes by degree (a fixed size, so one actor is one small group)."""
    deg = edges.select(actor, F.col("a").alias("n")).unionByName(edges.select(actor, F.col("b").alias("n"))).groupBy(actor, "n").count()
    best = deg.withColumn("r", F.row_number().over(W.partitionBy(actor).orderBy(F.desc("count"), "n"))).where(F.col("r") <= top).select(actor, "n")
    inner = edges.join(best.withColumnRenamed("n", "a"), [actor, "a"], "left_semi").join(best.withColumnRenamed("n", "b"), [actor, "b"], "left_semi").select(actor, "a", "b").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        score = dict.fromkeys(sorted(near), 0.0)
        for s in score:
            # shortest-path counts by breadth, then dependencies back from the farthest
            dist, paths, order = {s: 0}, {s: 1.0}, [s]
            for v in order:
                for w in sorted(near[v]):
                    if w not in dist:
                        dist[w], paths[w] = dist[v] + 1, 0.0
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
            share = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in near[w]:
                    if dist[v] == dist[w] - 1:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                if w != s:
                    score[w] += share[w] / 2
        return pd.DataFrame({actor: pdf[actor].iloc[0], "node": list(score), "betweenness": [round(x, 6) for x in score.values()]})

    return inner.groupBy(actor).applyInPandas(run, f"{actor} string, node string, betweenness double")


def cluster_by_cosine(vectors: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """vec_id, cluster: components of the similarity graph inside blocks; a vector alone is its own cluster."""
    comp = connected_components(similar_pairs(vectors, block, threshold, links=True).select("a", "b"))
    return vectors.select(*block, "vec_id").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(*block, "vec_id", F.coalesce("component", "vec_id").alias("cluster"))


def cluster_centroids(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector and size of each cluster, and the member nearest to the mean (smaller id on ties)."""
    v = clusters.join(vectors.select("vec_id", "embedding"), "vec_id")
    mean = v.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))
    j = v.join(mean, "cluster").withColumn("d", F.aggregate(F.zip_with("embedding", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    return j.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct("d", "vec_id")).alias("m"), F.first("centroid").alias("centroid")).select("cluster", "n", F.col("m.vec_id").alias("representative"), "centroid")


def pairwise_composite_distance(a: DataFrame, weights: tuple[float, float, float] = (0.4, 0.2, 0.4), days: int = 30, far: bool = True, size: int = 2 * TILE) -> DataFrame:
    """a: block, id, embedding, docs (array), day. Distances of pairs of a block; farther than `days` apart the distance is 1. Without far, only pairs within `days` are made, by ranges of days: those
    that a cut under 1 can ask for."""
    # tiles of a large block are larger, so that an event is sent to few of them
    v = _tiled(a, days, far, size, 4 * size)
    id_ = v.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from composite_pairs(pa.Table.from_batches(batches), weights, days, far)

    # a given number: small groups of bytes are large ones of pairs, and would be put together
    v = v.repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "_i", "_j")
    return v.groupBy("block", "_i", "_j").applyInArrow(run, f"a {id_}, b {id_}, distance double")


def composite_links(a: DataFrame, cut: float, weights: tuple[float, float, float] = (0.4, 0.2, 0.4), days: int = 30, size: int = 2 * TILE) -> DataFrame:
    """Of the pairs within `days` and under the cut those that a minimum spanning forest of a pair of tiles holds: fewer than its events. Together they have the components of all such pairs at every
    level, so clusters by single links are the same."""
    v = _tiled(a, days, False, size, size)

    def run(t: pa.Table) -> pa.Table:
        ids, first = t.column("id").to_numpy(), t.column("_left").to_numpy()
        alone = t.column("_i")[0].as_py() == t.column("_j")[0].as_py()
        left, right = np.flatnonzero(first), np.flatnonzero(first if alone else ~first)
        u, day = unit(t.column("embedding")), t.column("day").to_numpy().astype(float)  # no day is nan
        gap = np.abs(day[left][:, None] - day[right])
        many, shared = shared_counts(t.column("docs").combine_chunks(), left, right)
        d = _distance(u[left], u[right], many[left][:, None] + many[right] - shared, shared, gap, weights, days) / 1e6
        x, y = least_links(np.where((ids[left][:, None] != ids[right]) & (gap <= days) & (d < cut), d, np.inf), alone)
        a, b, kind = ids[left[x]], ids[right[y]], t.schema.field("id").type
        return pa.table({"a": pa.array(np.minimum(a, b), kind), "b": pa.array(np.maximum(a, b), kind), "distance": pa.array(d[x, y])})

    id_ = v.schema["id"].dataType.simpleString()
    return v.groupBy("block", "_i", "_j").applyInArrow(run, f"a {id_}, b {id_}, distance double")


def _tiled(a: DataFrame, days: int, far: bool, size: int, most: int) -> DataFrame:
    """Events of each pair of tiles (_i <= _j) that meet, and whether they are of _i: tiles of about `size` events of a block, and of a range of days without far, or of an eighth of it up to `most`."""
    v = a.select("block", "id", "embedding", F.array_distinct("docs").alias("docs"), F.unix_date("day").alias("day")).where("block IS NOT NULL")
    v = v.withColumn("_bin", F.lit(0).cast("long")) if far else v.where("day IS NOT NULL").withColumn("_bin", F.floor(F.col("day") / days))
    # a range of days meets itself and its neighbours, tile by tile
    n = v.groupBy("block", "_bin").agg(F.ceil(F.count("*") / F.greatest(F.lit(size), F.least(F.lit(most), F.count("*") / 8))).cast("int").alias("_n"))
    own = F.struct("_bin", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("_tile")).alias("_own")
    met = n.select("block", F.explode(F.array(*[F.col("_bin") + k for k in ((0,) if far else (-1, 0, 1))])).alias("_bin"), F.col("_bin").alias("_of"), "_n")
    met = met.select("block", "_bin", "_of", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_tile")).select("block", "_bin", F.struct(F.col("_of").alias("_bin"), "_tile").alias("_other"))
    v = v.join(n, ["block", "_bin"]).select("block", "_bin", own, "id", "embedding", "docs", "day").join(met, ["block", "_bin"])
    return v.select("block", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") <= F.col("_other")).alias("_left"), "id", "embedding", "docs", "day")


def _distance(u: np.ndarray, v: np.ndarray, either: np.ndarray, shared: np.ndarray, gap: np.ndarray, weights: tuple[float, float, float], days: int) -> np.ndarray:
    """Distances of rows of u from rows of v, in millionths. either: how many documents two rows have together."""
    like = np.divide(shared, either, out=np.zeros(either.shape), where=either > 0)
    return np.floor((weights[0] * (1 - u @ v.T) + weights[1] * (1 - like) + weights[2] * np.fmin(gap / days, 1.0)) * 1e6 + 0.5)


def composite_pairs(t: pa.Table, weights: tuple[float, float, float], days: int, far: bool, chunk: int = 4 * TILE, strip: int = 512, few: int = 64, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """All pairs of a pair of tiles, at most `most` in a batch. Chunks of the tiles meet one another; what is held is one number a pair of a chunk. Pairs within `days` come by distance, so that equal
    ones are neighbours and files of them are small; the others come row by row, in the order of days."""
    ids, first, embedding, docs = t.column("id").to_numpy(), t.column("_left").to_numpy(), t.column("embedding").combine_chunks(), t.column("docs").combine_chunks()
    alone = t.column("_i")[0].as_py() == t.column("_j")[0].as_py()
    day, kind = t.column("day").to_numpy().astype(float), t.schema.field("id").type  # no day is nan

    def chunks(rows: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(ids[rows], kind="stable")]
        return [c[np.argsort(day[c], kind="stable")] for c in (rows[i : i + chunk] for i in range(0, len(rows), chunk))]

    def batches(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), most):
            p, q = a[i : i + most], b[i : i + most]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), kind), pa.array(np.maximum(p, q), kind), pa.array(d[i : i + most])], ["a", "b", "distance"])

    lefts = chunks(np.flatnonzero(first))
    rights = lefts if alone else chunks(np.flatnonzero(~first))
    for i, left in enumerate(lefts):
        u = unit(embedding.take(pa.array(left)))
        for right in rights[i:] if alone else rights:
            v, theirs, other, n = unit(embedding.take(pa.array(right))), docs.take(pa.array(right)), ids[right], len(right)
            wide = min(u.shape[1], v.shape[1])  # what only one has counts as zeros
            held, at = np.empty(len(left) * n, np.int64), 0
            for k in range(0, len(left), few):  # a few rows at a time stay in the cache
                if k % strip == 0:
                    rows = left[k : k + strip]
                    many, counts = shared_counts(pa.concat_arrays([docs.take(pa.array(rows)), theirs]), np.arange(len(rows)), np.arange(len(rows), len(rows) + n))
                e = slice(k % strip, k % strip + few)
                mine, shared, gap = ids[rows[e]], counts[e], np.abs(day[rows[e]][:, None] - day[right])
                d = _distance(u[k : k + few, :wide], v[:, :wide], many[: len(rows)][e][:, None] + many[len(rows) :] - shared, shared, gap, weights, days)
                less, more = mine[:, None] < other, np.zeros(gap.shape, bool) if alone else mine[:, None] > other
                if not far:
                    less, more = less & (gap <= days), more & (gap <= days)
                apart = gap > days
                near = ~apart & (np.abs(d) < 1 << 38)  # not nan
                x, y = np.nonzero(near & (less | more))
                held[at : at + len(x)] = (d[x, y].astype(np.int64) << 24) | ((x + k) * n + y)
                at += len(x)
                d = np.where(apart, 1.0, d / 1e6)
                x, y = np.nonzero(~near & less)
                yield from batches(mine[x], other[y], d[x, y])
                y, x = np.nonzero((~near & more).T)
                yield from batches(mine[x], other[y], d[x, y])
            held[:at].sort()
            for k in range(0, at, most):
                d, place = np.divmod(held[k : min(at, k + most)], 1 << 24)
                x, y = np.divmod(place, n)
                yield from batches(ids[left[x]], other[y], d / 1e6)


def shared_counts(docs: pa.ListArray, left: np.ndarray, right: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """How many values each row has, and how many each row of left shares with each of right. docs: a list of distinct values a row."""
    many = pc.fill_null(pc.list_value_length(docs), 0).to_numpy().astype(np.int64)
    codes = docs.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy()
    start = np.cumsum(many) - many

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = many[rows]
        c = codes[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.argsort(c, kind="stable")
        return c[order], np.repeat(np.arange(len(rows)), n)[order]

    (lc, lr), (rc, rr) = entries(left), entries(right)
    low = np.searchsorted(rc, lc, "left")
    n = np.searchsorted(rc, lc, "right") - low
    out, total = np.zeros(len(left) * len(right), np.int64), np.cumsum(n)
    at = 0
    while at < len(lc):  # a value that many rows have makes many pairs: some at a time
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        m = n[at:to]
        place = np.repeat(low[at:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        np.add.at(out, np.repeat(lr[at:to], m) * len(right) + rr[place], 1)
        at = to
    return many, out.reshape(len(left), len(right))


def consolidate(distances: DataFrame, nodes: DataFrame, cut: float) -> DataFrame:
    """id, master: components of pairs under the cut; the master has most articles, then most days, then the smallest id."""
    return led(nodes, distances.where(F.col("distance") < cut).select("a", "b"), [-F.col("articles"), -F.col("days")])


def led(nodes: DataFrame, edges: DataFrame, order: list, id_: str = "id") -> DataFrame:
    """id, master: the components of edges (a, b) over nodes; the node that comes first in the order, then by id, is the master of its component."""
    comp = connected_components(edges).withColumnRenamed("node", id_)
    j = nodes.join(comp, id_, "left").withColumn("component", F.coalesce("component", id_))
    lead = j.groupBy("component").agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(id_).alias("id"))).alias("m"))
    return j.join(lead, "component").select(id_, F.col("m.id").alias("master"))


def consolidate_entities(entities: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """vec_id, master: components of entities alike by cosine in a block (country and type); the one with most documents leads. entities: vec_id, embedding, n_docs and the block's columns."""
    return led(entities.select("vec_id", "n_docs"), similar_pairs(entities, block, threshold, links=True).select("a", "b"), [-F.col("n_docs")], "vec_id")


def merge_canonical_entities(den: DataFrame, masters: DataFrame, rc: DataFrame, cat: DataFrame, events: DataFrame) -> DataFrame:
    """Masters after taking over their children's mentions: entity (the master), children, documents, mention days, first and last day, alternative names, associated events, and count maps of
    categories and recipients over the union of the documents. den: entity, mention_date, doc_id; masters: entity, master; events: entity, master_event."""
    m = den.join(masters, "entity")
    docs = m.select("master", "doc_id").distinct()
    g = m.groupBy("master").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("mention_date").alias("mention_days"), F.min("mention_date").alias("first_day"), F.max("mention_date").alias("last_day"), F.array_sort(F.collect_set(F.when(F.col("entity") != F.col("master"), F.col("entity")))).alias("alternative_names"))
    ev = events.join(masters, "entity").groupBy("master").agg(F.array_sort(F.collect_set("master_event")).alias("events"))

    def counts(bridge: DataFrame, column: str, name: str) -> DataFrame:
        c = docs.join(bridge, "doc_id").groupBy("master", F.col(column).alias("key")).agg(F.count("*").alias("n"))
        return c.groupBy("master").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))

    return g.join(ev, "master", "left").join(counts(cat, "category", "categories"), "master", "left").join(counts(rc, "recipient_country", "recipients"), "master", "left")


def link_entities_to_events(den: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct (entity, master event) that share a document on equi keys, both sides exploded."""
    return den.select("entity", "doc_id").distinct().join(docs.select("master", "doc_id").distinct(), "doc_id").select("entity", "master").distinct()


def entity_lookup(cen: DataFrame, term: str, k: int) -> DataFrame:
    exact = F.lower("entity") == term.lower()
    return cen.where(exact | F.col("entity").ilike(f"%{term}%")).orderBy(F.desc(exact), F.desc("total_documents"), "entity").limit(k)


def residual_duplicates(pairs: DataFrame, days: DataFrame, gap: int = 30) -> DataFrame:
    """Similar pairs whose ranges (id, first_day, last_day) are at most `gap` days apart."""
    side = lambda n: days.select(F.col("id").alias(n), F.col("first_day").alias(f"f{n}"), F.col("last_day").alias(f"l{n}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    return j.where(F.greatest(F.datediff("fa", "lb"), F.datediff("fb", "la")) <= gap).select("a", "b", "cosine")
