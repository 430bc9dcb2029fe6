"""Building and splitting events from clusters, names and decisions; themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import kmeans
from .graph import led, similar_pairs
from .store import forget, written

#: Vectors a task of a fit; themes that Spark's own fit is asked for.
ROWS, MOST = 1024, 256


def needs_review(clusters: DataFrame) -> DataFrame:
    """clusters: cluster, members (array<struct<name, doc_id>>). Those with more than one distinct name."""
    return clusters.where(F.size(F.array_distinct(F.transform("members", lambda x: x["name"]))) > 1)


def apply_group_decisions(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: cluster, group, idx (1-based place in the cluster's sorted distinct names). Members by group; clusters without decision are one group, unknown places are ignored. The group's
    name is its most frequent one, the smaller on ties."""
    m = clusters.select("cluster", F.explode("members").alias("m")).select("cluster", "m.name", "m.doc_id")
    names = m.groupBy("cluster").agg(F.array_sort(F.collect_set("name")).alias("names")).select("cluster", F.posexplode("names").alias("i", "name"))
    d = names.join(decisions.select("cluster", "group", (F.col("idx") - 1).alias("i")), ["cluster", "i"])
    none = names.join(decisions.select("cluster").distinct(), "cluster", "left_anti").select("cluster", "name", F.lit(0).alias("group"))
    g = m.join(d.select("cluster", "name", "group").unionByName(none), ["cluster", "name"])
    n = g.groupBy("cluster", "group", "name").agg(F.count("*").alias("n"))
    lead = n.groupBy("cluster", "group").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b")).select("cluster", "group", F.col("b.name").alias("event_name"))
    return g.groupBy("cluster", "group").agg(F.count_distinct("doc_id").alias("n_docs")).join(lead, ["cluster", "group"])


def build_canonical_events(groups: DataFrame, existing: DataFrame, rc: DataFrame, cat: DataFrame) -> DataFrame:
    """groups: initiating_country, event_name, day, doc_id (one row a document), existing: id, initiating_country, event_name, first_day, last_day, articles. Days that an existing event of that name and
    country spans extend it (the smallest id on ties); the others become events, days that follow without a gap one event: gaps and islands over sorted days. id is null for new events; count maps of
    recipients and categories are over the group's distinct documents."""
    key = ["initiating_country", "event_name"]
    days = groups.groupBy(*key, "day").agg(F.count_distinct("doc_id").alias("n_docs"))
    known = days.join(existing.select("id", *key, F.col("first_day").alias("f"), F.col("last_day").alias("l")), key).where("day BETWEEN f AND l").groupBy(*key, "day").agg(F.min("id").alias("id"))
    days = days.join(known, [*key, "day"], "left")
    w = W.partitionBy(*key).orderBy("day")
    new = F.when(F.datediff("day", F.lag("day").over(w)) <= 1, 0).otherwise(1)
    fresh = days.where("id IS NULL").withColumn("new", new).withColumn("island", F.sum("new").over(w)).drop("new")
    placed = fresh.unionByName(days.where("id IS NOT NULL").withColumn("island", F.lit(None).cast("long")))
    k = [*key, "id", "island"]
    g = placed.groupBy(*k).agg(F.min("day").alias("a"), F.max("day").alias("z"), F.sum("n_docs").alias("n"), F.count("*").alias("days"))
    old = existing.select("id", F.col("first_day").alias("f"), F.col("last_day").alias("l"), "articles")
    g = g.join(old, "id", "left").select(*k, F.coalesce("f", "a").alias("first_day"), F.greatest("l", "z").alias("last_day"), (F.col("n") + F.coalesce("articles", F.lit(0))).alias("total_articles"), "days")
    docs = groups.select(*key, "day", "doc_id").distinct().join(placed.select(*k, "day"), [*key, "day"]).select(*k, "doc_id").distinct()
    same = F.xxhash64(*k).alias("h")  # nulls among the keys

    def counts(bridge: DataFrame, column: str, name: str) -> DataFrame:
        c = docs.withColumn("h", same).join(bridge, "doc_id").groupBy("h", F.col(column).alias("key")).agg(F.count("*").alias("n"))
        return c.groupBy("h").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))

    return g.withColumn("h", same).join(counts(rc, "recipient_country", "primary_recipients"), "h", "left").join(counts(cat, "category", "primary_categories"), "h", "left").drop("h")


def consolidate_layered(vectors: DataFrame, threshold: float, boundary_days: int = 7) -> DataFrame:
    """vec_id, master: similarity graph inside (country, month), and across a month's end for rows within boundary_days of it. Validated rows lead, then those with most articles, then the smallest id.
    vectors: vec_id, country, day, embedding, validated, articles."""
    v = vectors.withColumn("month", F.trunc("day", "month"))
    inside = similar_pairs(v, ["country", "month"], threshold)
    late = F.datediff(F.add_months("month", 1), "day") <= boundary_days
    early = F.datediff("day", "month") < boundary_days
    edge = v.where(late).withColumn("cut", F.add_months("month", 1)).unionByName(v.where(early).withColumn("cut", F.col("month")))
    across = similar_pairs(edge, ["country", "cut"], threshold)
    edges = inside.select("a", "b").unionByName(across.select("a", "b"))
    return led(vectors.select("vec_id", "validated", "articles"), edges, [~F.col("validated"), -F.col("articles")], "vec_id")


def apply_split(blocks: DataFrame, mentions: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The parts of split events: canonical_event_id, part, keeps, statistics and peak. blocks: canonical_event_id, mention_date, block; mentions: also article_count and name (the day's headline).

    decisions: canonical_event_id, block, keep, proposed_name. Blocks that they keep stay with the event; without any, the largest block does (the earlier on ties). Other blocks become new events by
    name; blocks of one name are one. A name that is missing, shorter than 8 letters or a placeholder gives way to the headline of the block's largest day. Events of one block are not split."""
    j = mentions.join(blocks, ["canonical_event_id", "mention_date"])
    key = ["canonical_event_id", "block"]
    g = j.groupBy(*key).agg(F.sum("article_count").alias("articles"), F.min(F.struct((-F.col("article_count")).alias("n"), "mention_date", "name")).alias("best"))
    if decisions is None:
        g = g.withColumns({"keep": F.lit(False), "proposed_name": F.lit(None).cast("string")})
    else:
        g = g.join(decisions, key, "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    every = W.partitionBy("canonical_event_id")
    g = g.withColumns({"blocks": F.count("*").over(every), "kept": F.max("keep").over(every), "r": F.row_number().over(every.orderBy(F.desc("articles"), "block"))})
    keeps = F.when(F.col("kept"), F.col("keep")).otherwise(F.col("r") == 1)
    name = F.lower(F.trim("proposed_name"))
    empty = F.coalesce((F.length("proposed_name") < 8) | name.contains("event name") | name.contains("<") | name.contains(">") | name.contains("specific real-world"), F.lit(True))
    part = F.when(keeps, "").otherwise(F.when(empty, F.substring("best.name", 1, 200)).otherwise(F.col("proposed_name")))
    named = g.where("blocks > 1").select(*key, part.alias("part"), keeps.alias("keeps"))
    days = j.join(named, key).groupBy("canonical_event_id", "part", "keeps", "mention_date").agg(F.sum("article_count").alias("n"))
    s = days.groupBy("canonical_event_id", "part", "keeps").agg(F.sum("n").alias("articles"), F.count("*").alias("days"), F.min("mention_date").alias("first_day"), F.max("mention_date").alias("last_day"), F.min(F.struct((-F.col("n")).alias("n"), "mention_date")).alias("p"))
    return s.select("canonical_event_id", "part", "keeps", "articles", "days", "first_day", "last_day", F.col("p.mention_date").alias("peak_day"), (-F.col("p.n")).alias("peak_articles"))


def keep_proposition(df: DataFrame, markers: str) -> DataFrame:
    """Reason to drop: no foreign recipient, a private person without a state title (markers: a pattern), or the initiator itself. df: id, initiator, recipients (array), text, private."""
    foreign = F.size(F.array_except("recipients", F.array("initiator"))) > 0
    reason = F.when(F.size("recipients") == 0, "no recipient").when(~foreign, "self-country").when(F.col("private") & ~F.col("text").rlike(markers), "private individual")
    return df.withColumn("reason", reason)


def narrative_themes(vectors: DataFrame, k: int | None = None, parts: int = 50, seed: int = 42, most: int = MOST) -> DataFrame:
    """vec_id, theme, coherence (mean cosine to the centroid, in the reduced space): unit vectors, PCA, k-means. Spark's own k-means clusters candidates for its start on the driver, in time that grows with
    the square of the themes; for more themes than `most`, seeds and steps are jobs (see kmeans)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = vectors.count()
    # a fit takes as many tasks as its rows lie in, and a small file is one
    dealt = lambda df: df.repartition(max(1, -(-n // ROWS)), "vec_id").sortWithinPartitions("vec_id")
    unit = Normalizer(inputCol="v", outputCol="u").transform(dealt(vectors.select("vec_id", array_to_vector("embedding").alias("v"))))
    small, at = written(PCA(k=parts, inputCol="u", outputCol="p").fit(unit).transform(unit).select("vec_id", vector_to_array("p").alias("p")), "reduced")
    k, places = k or max(20, n // 25), [at]
    if k > most:
        held, at = written(kmeans.blocks(dealt(small)), "blocks")
        places.append(at)
        themed = kmeans.assigned(small, kmeans.fit(held, k, seed), "theme")
    else:
        small = dealt(small).select("vec_id", array_to_vector("p").alias("p"))
        themed = KMeans(k=k, seed=seed, featuresCol="p", predictionCol="theme").fit(small).transform(small).withColumn("p", vector_to_array("p"))
    themed, _ = written(themed.select("vec_id", "theme", "p"), "themed")
    forget(vectors.sparkSession, *places)
    mean = themed.select("theme", F.posexplode("p").alias("i", "x")).groupBy("theme", "i").agg(F.avg("x").alias("x")).groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))
    return themed.join(mean, "theme").select("vec_id", "theme", F.avg(C.cosine_similarity(F.col("p"), F.col("c"))).over(W.partitionBy("theme")).alias("coherence"))


def theme_summary(themes: DataFrame, events: DataFrame, recipients: DataFrame, stop: list[str], k: int = 6) -> DataFrame:
    """Per theme: events, coherence, the k terms with the largest tf-idf over themes (without stop words), count maps of actors and recipients and their sizes, mean score (null counts as 0), first and
    last day. events: vec_id, name, actor, score, day; recipients: vec_id, recipient."""
    j = themes.join(events, "vec_id")
    t = j.select("theme", F.explode(F.split(F.lower("name"), "[^a-z0-9]+")).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*stop)).groupBy("theme", "term").agg(F.count("*").alias("tf"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    n = themes.agg(F.count_distinct("theme").alias("n"))
    s = t.join(df, "term").crossJoin(F.broadcast(n)).withColumn("s", F.round(F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1), 9))  # one row
    top = s.withColumn("r", F.row_number().over(W.partitionBy("theme").orderBy(F.desc("s"), "term"))).where(F.col("r") <= k).groupBy("theme").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("terms"))

    def counts(df: DataFrame, column: str, name: str) -> DataFrame:
        c = df.groupBy("theme", F.col(column).alias("key")).agg(F.count("*").alias("n")).where("key IS NOT NULL")
        return c.groupBy("theme").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name), F.count("*").alias(f"n_{name}"))

    g = j.groupBy("theme").agg(F.count("*").alias("n"), F.round(F.avg("coherence"), 6).alias("coherence"), F.round(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))), 2).alias("mean_score"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    g = g.join(top, "theme", "left").join(counts(j, "actor", "actors"), "theme", "left").join(counts(j.join(recipients, "vec_id"), "recipient", "recipients"), "theme", "left")
    return g.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_actors", "n_recipients")})


def coherent_campaigns(summary: DataFrame, coherence: float = 0.5, events: int = 10, recipients: int = 4, k: int = 14) -> DataFrame:
    """Themes of many events and recipients that hold together, with the actor that has most of their events."""
    ok = summary.where((F.col("n_recipients") >= recipients) & (F.col("n") >= events) & (F.col("coherence") >= coherence))
    return ok.withColumn("dominant", C.dominant_key(F.col("actors"))).orderBy(F.desc("coherence"), "theme").limit(k)


def recipient_blocs(profiles: DataFrame, ks: range = range(3, 7), seed: int = 42) -> DataFrame:
    """recipient_country, bloc: bisecting k-means of share profiles, k by silhouette."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    # lanes are actors times categories of the scope, one row a recipient
    lanes = profiles.select("lane").distinct().agg(F.array_sort(F.collect_list("lane")).alias("lanes"))
    held = profiles.groupBy("recipient_country").agg(F.map_from_entries(F.collect_list(F.struct("lane", "share"))).alias("m")).crossJoin(F.broadcast(lanes))
    v = held.select("recipient_country", array_to_vector(F.transform("lanes", lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0)))).alias("features"))
    v, _ = written(v, "profiles")
    best, out = -2.0, None
    for k in ks:
        p = BisectingKMeans(k=k, seed=seed, maxIter=5).fit(v).transform(v)
        s = ClusteringEvaluator().evaluate(p) if p.select("prediction").distinct().count() > 1 else -1.0
        if s > best:
            best, out = s, p
    return out.select("recipient_country", F.col("prediction").alias("bloc"))

