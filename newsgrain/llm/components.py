"""Connected components by contraction, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every node of edges (a, b), comp being the smallest node of its component.

    Each round, every node takes the smallest of itself and its neighbours, follows that three steps further, and the edges are contracted to where their ends came to. All
    nodes but local minima vanish, so the edges shrink at least by half a round; each round is written to the shared folder."""
    pair = lambda a, b: edges_between(F.least(a, b), F.greatest(a, b))
    left = saved(edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("node"), "p")
        used = []
        for _ in range(2):
            up = saved(up, "parents")
            used.append(up)
            up = up.join(up.select(F.col("node").alias("p"), F.col("p").alias("pp")), "p").select("node", F.col("pp").alias("p"))
        up = saved(up, "parents")
        used.append(up)
        to = lambda side: up.select(F.col("node").alias(side), F.col("p").alias(f"p{side}"))
        after = left.join(to("a"), "a").join(to("b"), "b").where("pa <> pb").select(*pair(F.col("pa"), F.col("pb"))).distinct()
        if found is None:
            found = saved(up.select("node", F.col("p").alias("comp")), "components")
        else:
            moved = found.join(up.select(F.col("node").alias("comp"), "p"), "comp", "left")
            used.append(found)
            found = saved(moved.select("node", F.coalesce("p", "comp").alias("comp")), "components")
        used.append(left)
        left = saved(after, "edges")
        dropped(*used)
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def edges_between(a, b):
    return a.alias("a"), b.alias("b")
