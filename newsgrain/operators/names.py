"""Names that contain or resemble one another, without comparing all with all. Every candidate key is a gram that two such names must share, the rarest that will do."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .store import forget, written


def raw_grams(c: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    return F.array_distinct(F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """Distinct (part, whole): names of short (column part) that occur in names of long (column whole). A part is looked up by its rarest run of three characters, or by all of it if it is shorter."""
    s = short.select("part").distinct().where("part <> ''")
    g = s.select("part", F.explode(F.when(F.length("part") >= 3, raw_grams(F.col("part"), 3)).otherwise(F.array("part"))).alias("g"))
    w = long.select("whole").distinct()
    wanted = g.select("g").distinct()
    held = w.select("whole", F.explode(F.array_union(raw_grams(F.col("whole"), 3), F.array_union(raw_grams(F.col("whole"), 2), raw_grams(F.col("whole"), 1)))).alias("g")).join(wanted, "g", "left_semi")
    df = held.groupBy("g").agg(F.count("*").alias("df"))
    rare = g.join(df, "g", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r")).select("part", F.col("r.g").alias("g"))
    return rare.join(held, "g").where(F.contains("whole", "part")).select("part", "whole").distinct()


def sharing(a: DataFrame, b: DataFrame, grams, needed) -> DataFrame:
    """Distinct candidate (x, y) of names a.x and b.y that share one of their rarest grams. needed(column of the number of grams, of the name): how many grams any partner must share; a name with n grams,
    m of them shared, has a shared one among its n - m + 1 rarest."""
    side = lambda df, c: df.select(c).distinct().withColumn("gs", grams(F.col(c))).withColumn("n", F.size("gs"))
    x, y = side(a, "x"), side(b, "y")
    every = x.select(F.explode("gs").alias("g")).unionByName(y.select(F.explode("gs").alias("g")))
    df = every.groupBy("g").agg(F.count("*").alias("df"))

    def rarest(s: DataFrame, c: str) -> DataFrame:
        t = s.select(c, "n", F.explode("gs").alias("g")).join(df, "g")
        t = t.withColumn("r", F.row_number().over(W.partitionBy(c).orderBy("df", "g")))
        return t.where(F.col("r") <= F.greatest(F.lit(1), F.col("n") - needed(F.col("n"), F.col(c)) + 1)).select(c, "g")

    return rarest(x, "x").join(rarest(y, "y"), "g").select("x", "y").distinct()


def like_by_trigrams(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(x, y, similarity): trigram similarity of at least `least`. Similarity s needs at least s * n shared trigrams of a name's n."""
    return sharing(a, b, C.trigrams, lambda n, _: F.ceil(n * least - 1e-9)).withColumn("similarity", C.trigram_similarity(F.col("x"), F.col("y"))).where(F.col("similarity") >= least)


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def like_by_edits(names: DataFrame, above: float) -> DataFrame:
    """(x, y, similarity), x <> y, of distinct names with a normalised edit similarity above `above`. d edits leave all but 2 d of a name's pairs of neighbouring characters (blanks around it), counted
    with repeats, in place; a partner is at most 1 / above times as long."""

    def grams(c: Column) -> Column:
        t = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
        pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
        # repeats are told apart by a number, so that sets count like bags
        return F.transform(pairs, lambda g, i: F.concat(g, (i - F.array_position(pairs, g) + 1).cast("string")))

    most = math.nextafter((1 - above) / above, 2)
    needed = lambda n, c: F.greatest(F.lit(0), n - 2 * F.floor(F.length(c) * most))
    n = names.select("name").distinct()
    pairs = sharing(n.withColumnRenamed("name", "x"), n.withColumnRenamed("name", "y"), grams, needed).where("x <> y")
    return pairs.withColumn("similarity", edit_similarity(F.col("x"), F.col("y"))).where(F.col("similarity") > above)


def similar_name_pairs(names: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Distinct names a < b one of which contains the other, or whose trigram similarity exceeds the threshold."""
    n = names.select("name").distinct().where("name IS NOT NULL")
    inside = containing(n.withColumnRenamed("name", "part"), n.withColumnRenamed("name", "whole")).where("part <> whole").select(F.least("part", "whole").alias("a"), F.greatest("part", "whole").alias("b"))
    like = like_by_trigrams(n.withColumnRenamed("name", "x"), n.withColumnRenamed("name", "y"), threshold).where((F.col("x") < F.col("y")) & (F.col("similarity") > threshold)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return inside.unionByName(like).distinct().withColumn("similarity", F.round(C.trigram_similarity(F.col("a"), F.col("b")), 6))


def dedupe_fuzzy_names(names: DataFrame, threshold: float = 0.78) -> DataFrame:
    """names: name, rank (a name once). In order of rank, a name stays unless it resembles one that stayed. In rounds: a name all of whose better-ranked likes are gone stays, and its worse-ranked likes
    go; each round decides the best-ranked name of every group of likes at least, and is written to the shared folder."""
    spark = names.sparkSession
    names, first = written(names.select("name", "rank"), "names")  # every step asks them again
    ranked = lambda c, r: names.select(F.col("name").alias(c), F.col("rank").alias(r))
    edges = like_by_edits(names, threshold).join(ranked("x", "rx"), "x").join(ranked("y", "ry"), "y").where("rx < ry OR rx = ry AND x < y").select("x", "y")
    edges, at = written(edges, "likes")
    places, gone, left = [first, at], None, edges
    while not left.isEmpty():
        kept = left.select(F.col("x").alias("name")).distinct().join(left.select(F.col("y").alias("name")), "name", "left_anti")
        now = left.join(kept.withColumnRenamed("name", "x"), "x", "left_semi").select(F.col("y").alias("name")).distinct()
        gone, at = written(now if gone is None else gone.unionByName(now).distinct(), "gone")
        places.append(at)
        no = lambda c: gone.select(F.col("name").alias(c))  # noqa: B023, E731
        left, at = written(left.join(no("x"), "x", "left_anti").join(no("y"), "y", "left_anti"), "left")
        places.append(at)
    out = names if gone is None else names.join(gone, "name", "left_anti")
    out, at = written(out, "deduped")
    forget(spark, *places)
    return out


def match_entities(queries: DataFrame, entities: DataFrame, k: int, similar: float = 0.7, near: float = 0.6, most: int = 200) -> DataFrame:
    """query, entity, tier, score: for each query the k best entities. Tier 1 holds the query (any case), tier 2 resembles it by trigrams, tier 3 is among the `most` nearest with a cosine of at least
    near. An entity counts in its first tier. queries: query_id, query, q; entities: vec_id, entity, embedding."""
    from .tiles import nearest

    low = lambda df, c, n: df.select(F.lower(c).alias(n))
    q, e = queries.select("query", F.lower("query").alias("lq")), entities.select("entity", F.lower("entity").alias("le"))
    first = containing(low(queries, "query", "part"), low(entities, "entity", "whole")).select(F.col("part").alias("lq"), F.col("whole").alias("le"), F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    second = like_by_trigrams(low(queries, "query", "x"), low(entities, "entity", "y"), similar).select(F.col("x").alias("lq"), F.col("y").alias("le"), F.lit(2).alias("tier"), F.round("similarity", 6).alias("score"))
    text = first.unionByName(second).join(q, "lq").join(e, "le").select("query", "entity", "tier", "score")
    n = nearest(queries.select("query_id", "q"), entities.select("vec_id", "embedding"), most)
    n = n.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where((F.col("r") <= most) & (F.col("score") >= near))
    third = n.join(queries.select("query_id", "query"), "query_id").join(entities.select("vec_id", "entity"), "vec_id").select("query", "entity", F.lit(3).alias("tier"), "score")
    best = text.unionByName(third).groupBy("query", "entity").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("b")).select("query", "entity", F.col("b.tier").alias("tier"), (-F.col("b.s")).alias("score"))
    w = W.partitionBy("query").orderBy("tier", F.desc("score"), "entity")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query", "entity", "tier", "score")
