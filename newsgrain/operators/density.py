"""Density clustering over a table of pair distances.

Distances become mutual-reachability distances, of which the minimum spanning forest holds every component at every level. A component whose days span more than the gate is cut at its weakest links
until its pieces fit; of each piece the tree of denser and denser clusters is condensed, and those clusters are taken that hold the most excess of mass. What belongs to none of them is noise and
stays single. Links that weigh the same are cut at once, so the result depends on no order.

Small components are one group each. In a component of many pairs the forest is found first, by rounds in which each part takes its least link to another (written to the shared folder); then only
one link an event is left, which is what a group holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import connected_components
from .store import forget, written

PAIRS = 1 << 16
#: Distances under this count as it, so that the density of equal events is finite.
LEAST = 1e-6


def mutual_reachability(pairs: DataFrame, cut: float, neighbours: int = 1) -> DataFrame:
    """a, b, w for pairs (a, b, distance) under the cut: the greatest of the distance and the two ends' distances to their `neighbours`-th neighbour; an end with fewer neighbours has none of its links."""
    near = pairs.where(F.col("distance") < cut).select("a", "b", "distance")
    if neighbours == 1:  # no link is shorter than that to the nearest neighbour
        return near.withColumnRenamed("distance", "w")
    ends = near.select(F.col("a").alias("id"), "distance").unionByName(near.select(F.col("b").alias("id"), "distance"))
    core = ends.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("distance"))).where(F.col("r") == neighbours).select("id", F.col("distance").alias("core"))
    side = lambda n: core.select(F.col("id").alias(n), F.col("core").alias(f"c{n}"))
    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.greatest("distance", "ca", "cb").alias("w"))


def spanning_forest(links: DataFrame) -> DataFrame:
    """The links (a, b, w) of the minimum spanning forest; of links that weigh the same the least by (a, b). Each round at least halves the parts, and of the links between two parts keeps the least."""
    spark = links.sparkSession
    left, at = written(links.select(F.col("a").alias("p"), F.col("b").alias("q"), F.struct("w", "a", "b").alias("e")), "links")
    out = None
    while not left.isEmpty():
        each = left.select(F.col("p").alias("part"), F.struct("e", "p", "q").alias("best")).unionByName(left.select(F.col("q").alias("part"), F.struct("e", "p", "q").alias("best")))
        best, _ = written(each.groupBy("part").agg(F.min("best").alias("best")).select("best.*").distinct(), "least-links")
        out = best.select("e") if out is None else out.unionByName(best.select("e"))
        parts = connected_components(best.select(F.col("p").alias("a"), F.col("q").alias("b")))
        to = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"n{side}"))
        moved = left.join(to("p"), "p").join(to("q"), "q").where("np <> nq").groupBy(F.least("np", "nq").alias("p"), F.greatest("np", "nq").alias("q")).agg(F.min("e").alias("e"))
        after, place = written(moved, "links")
        forget(spark, at)
        left, at = after, place
    return (out if out is not None else left.select("e")).select("e.a", "e.b", "e.w")


def single_linkage(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, day: np.ndarray) -> tuple[list[int], list[list[int]], list[float], list[int], list[int]]:
    """Merges of n nodes by links: nodes 0 to n - 1 are leaves. The uppermost nodes; for each node its children, level, size and span in days. Links of one weight that meet make one node of several children."""
    children: list[list[int]] = [[] for _ in range(n)]
    level, size, first, last = [0.0] * n, [1] * n, day.tolist(), day.tolist()
    top, parent = list(range(n)), list(range(n))  # node that stands for a set, kept at the set's root

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.lexsort((b, a, w)):
        x, y, weight = root(int(a[k])), root(int(b[k])), float(w[k])
        if x == y:
            continue
        parts = []
        for node in (top[x], top[y]):
            parts += children[node] if node >= n and level[node] == weight else [node]
        if size[top[x]] < size[top[y]]:
            x, y = y, x
        parent[y] = x
        children.append(parts)
        level.append(weight)
        size.append(sum(size[p] for p in parts))
        first.append(min(first[p] for p in parts))
        last.append(max(last[p] for p in parts))
        top[x] = len(children) - 1
    return sorted({top[root(x)] for x in range(n)}), children, level, size, [y - x for x, y in zip(first, last, strict=True)]


def excess_of_mass(children: list[list[int]], level: list[float], size: list[int], top: int, birth: float, least: int) -> list[int]:
    """The nodes, under and including top, of the clusters with most excess of mass. birth: the density at which top came apart from the rest."""
    clusters: list[tuple[int, float, float, list[int]]] = []  # node, birth, mass, clusters below
    todo = [(top, birth, -1)]
    while todo:
        node, born, above = todo.pop()
        own, mass, here = len(clusters), 0.0, node
        while True:
            density = 1 / max(level[here], LEAST)
            large = [c for c in children[here] if size[c] >= least]
            if len(large) == 1:
                mass += (size[here] - size[large[0]]) * (density - born)
                here = large[0]
                continue
            mass += size[here] * (density - born)
            break
        clusters.append((node, born, mass, []))
        if above >= 0:
            clusters[above][3].append(own)
        todo += [(c, density, own) for c in large]
    best, taken = [0.0] * len(clusters), [True] * len(clusters)
    for k in range(len(clusters) - 1, -1, -1):  # clusters below come later
        below = sum(best[c] for c in clusters[k][3])
        taken[k] = not clusters[k][3] or below <= clusters[k][2]
        best[k] = clusters[k][2] if taken[k] else below
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        if taken[k]:
            out.append(clusters[k][0])
        else:
            todo += clusters[k][3]
    return out


def labels(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, day: np.ndarray, cut: float, gate: int, least: int) -> np.ndarray:
    """Least id of each node's cluster, and the node's own id for noise. a, b: places of the links' ends in ids (sorted)."""
    tops, children, level, size, span = single_linkage(len(ids), a, b, w, day)
    out, stack = ids.copy(), [(node, cut) for node in tops]
    while stack:
        node, above = stack.pop()
        if size[node] < least:
            continue
        if span[node] > gate:
            stack += [(c, level[node]) for c in children[node]]
            continue
        for chosen in excess_of_mass(children, level, size, node, 1 / max(above, LEAST), least):
            members, inner = [], [chosen]
            while inner:
                x = inner.pop()
                if x < len(ids):
                    members.append(x)
                inner += children[x]
            out[members] = ids[members].min()
    return out


def density_clusters(pairs: DataFrame, days: DataFrame, cut: float = 1.0, gate: int = 30, least: int = 2, neighbours: int = 1, most: int = PAIRS) -> DataFrame:
    """id, cluster (its least id; the own id for noise) of each event of days (id, day), from pairs (a, b, distance). Pairs that are not given are at least `cut` apart."""
    links, _ = written(mutual_reachability(pairs, cut, neighbours), "reachability")
    comp = connected_components(links.select("a", "b"))
    own = links.join(comp.select(F.col("node").alias("a"), "component"), "a")
    many = own.groupBy("component").count().where(F.col("count") > most).select("component")
    large = own.join(many, "component", "left_semi")
    forest = spanning_forest(large.select("a", "b", "w")).join(comp.select(F.col("node").alias("a"), "component"), "a")
    kept = own.join(many, "component", "left_anti").select("component", "a", "b", "w").unionByName(forest.select("component", "a", "b", "w"))
    side = lambda n: days.select(F.col("id").alias(n), F.unix_date("day").alias(f"d{n}"))
    kept = kept.join(side("a"), "a").join(side("b"), "b").select("component", "a", "b", "w", "da", "db")
    kind = days.schema["id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        a, b, w, da, db = (t.column(c).to_numpy() for c in ("a", "b", "w", "da", "db"))
        ids, at = np.unique(np.concatenate([a, b]), return_index=True)
        day = np.concatenate([da, db])[at]
        return pa.table({"id": pa.array(ids, t.schema.field("a").type), "cluster": pa.array(labels(ids, np.searchsorted(ids, a), np.searchsorted(ids, b), w, day, cut, gate, least), t.schema.field("a").type)})

    found = kept.groupBy("component").applyInArrow(run, f"id {kind}, cluster {kind}")
    return days.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def consolidate_by_density(pairs: DataFrame, nodes: DataFrame, cut: float = 1.0, gate: int = 30, most: int = PAIRS) -> DataFrame:
    """id, master of nodes (id, day, articles, days): the master of a cluster has most articles, then most days, then the smallest id; noise is its own master."""
    j = nodes.join(density_clusters(pairs, nodes.select("id", "day"), cut, gate, most=most), "id")
    lead = j.groupBy("cluster").agg(F.min(F.struct((-F.col("articles")).alias("a"), (-F.col("days")).alias("d"), "id")).alias("m"))
    return j.join(lead, "cluster").select("id", F.col("m.id").alias("master"))
