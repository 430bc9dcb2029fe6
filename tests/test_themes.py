"""Figures of themes, campaigns and blocs against plain loops over an assignment."""

import collections
import datetime as dt
import math
import random
import re

import numpy as np
import pytest

from newsgrain.operators import construct, kmeans
from newsgrain.operators.store import written

DAY = dt.date(2024, 1, 1)


def test_coherence_of_themes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    v = np.array([centres[i % 4] + 0.2 * rng.normal(size=12) for i in range(120)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in construct.narrative_themes(df, k=4, parts=5).collect()}
    # the four planted groups are found
    assert len({got[i].theme for i in range(4)}) == 4 and all(got[i].theme == got[i % 4].theme for i in got)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    small = unit @ np.linalg.eigh(np.cov(unit.T))[1][:, ::-1][:, :5]
    for theme in range(4):
        mine = small[theme::4]
        mean = mine.mean(axis=0)
        want = (mine @ mean / np.linalg.norm(mine, axis=1) / np.linalg.norm(mean)).mean()
        assert all(got[i].coherence == pytest.approx(want, abs=1e-6) for i in range(theme, 120, 4))


def test_many_themes_take_no_fit_on_the_driver(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    monkeypatch.setattr(KMeans, "fit", lambda *args: pytest.fail("seeds of this fit are clustered on the driver"))
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(300, 24))
    v = np.array([centres[i % 300] + 0.02 * rng.normal(size=24) for i in range(7500)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = construct.narrative_themes(df, parts=20).collect()  # 7,500 vectors are 300 themes
    group = collections.defaultdict(set)
    for r in got:
        group[r.theme].add(r.vec_id % 300)
    # nearly every theme is one planted group: k-means may join a few and split as many
    assert len(got) == 7500 and sum(len(g) == 1 for g in group.values()) > 270 and len(set().union(*group.values())) == 300
    assert all(r.coherence > 0.98 for r in got if len(group[r.theme]) == 1)
    assert construct.narrative_themes(df, parts=20).exceptAll(spark.createDataFrame(got)).isEmpty()


def test_kmeans_of_blocks(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    v = rng.normal(size=(5000, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, p array<double>").repartition(3, "vec_id").sortWithinPartitions("vec_id")
    held, _ = written(kmeans.blocks(df), "blocks")
    start = kmeans.seeds(held, 120, 1)
    assert start.shape == (120, 6) and len({tuple(x) for x in start}) == 120 and {tuple(x) for x in start} <= {tuple(x) for x in v}
    gaps = lambda c: ((v[:, None] - c[None]) ** 2).sum(axis=2)
    # a step against a plain loop; a centre that nothing is near stays
    far = np.concatenate([start, [[99.0] * 6]])
    near = gaps(far).argmin(axis=1)
    assert np.allclose(kmeans.stepped(held, far), [v[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(far)], atol=1e-12)
    got = {r.vec_id: r.theme for r in kmeans.assigned(df, far, "theme").collect()}
    assert [got[i] for i in range(5000)] == near.tolist()
    # not worse than Spark's own fit
    spark_fit = KMeans(k=120, seed=1, featuresCol="v").fit(df.select(array_to_vector("p").alias("v")))
    assert gaps(kmeans.fit(held, 120, 1)).min(axis=1).sum() < 1.03 * gaps(np.array(spark_fit.clusterCenters())).min(axis=1).sum()


def test_fewer_different_vectors_than_centres(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "vec_id long, p array<double>").repartition(2, "vec_id")
    held, _ = written(kmeans.blocks(df), "blocks")
    assert sorted(map(tuple, kmeans.fit(held, 20, 3))) == [(float(i), 1.0) for i in range(7)]
    assert len(kmeans.fit(held.where("n < 0"), 20, 3)) == 0


def test_theme_summary_and_campaigns(spark):
    rng = random.Random(6)
    said = ["trade", "port", "loan", "the", "of", "aid", "Summit", "grid", "x1"]
    themes = [(i, rng.randint(0, 5), rng.choice([0.4, 0.5, 0.9])) for i in range(90)]
    # one event in nine is not there, some have no actor, score or day
    events = [(i, ", ".join(rng.choices(said, k=rng.randint(0, 5))), rng.choice([None, "A", "B", "C"]), rng.choice([None, 1, 5]), rng.choice([None, *(DAY + dt.timedelta(k) for k in range(9))])) for i in range(90) if i % 9]
    recipients = sorted({(rng.randint(0, 95), rng.choice("PQRSTU")) for _ in range(200)})
    args = (
        spark.createDataFrame(themes, "vec_id long, theme int, coherence double"),
        spark.createDataFrame(events, "vec_id long, name string, actor string, score int, day date"),
        spark.createDataFrame(recipients, "vec_id long, recipient string"),
    )
    got = {r.theme: r for r in construct.theme_summary(*args, ["the"], 3).collect()}
    of = {i: t for i, t, _ in themes}
    tf = collections.defaultdict(collections.Counter)
    for i, name, *_ in events:
        tf[of[i]].update(w for w in re.split("[^a-z0-9]+", name.lower()) if len(w) > 2 and w != "the")
    df, n = collections.Counter(w for c in tf.values() for w in c), len(set(of.values()))
    assert set(got) == {of[i] for i, *_ in events}
    for t, r in got.items():
        mine = [e for e in events if of[e[0]] == t]
        best = sorted(tf[t], key=lambda w: (-round(tf[t][w] * (math.log((1 + n) / (1 + df[w])) + 1), 9), w))[:3]
        actors = collections.Counter(e[2] for e in mine if e[2])
        to = collections.Counter(p for i, p in recipients if i in {e[0] for e in mine})
        days = [e[4] for e in mine if e[4]]
        assert (r.n, r.terms, dict(r.actors), r.n_actors, dict(r.recipients), r.n_recipients) == (len(mine), " ".join(best), dict(actors), len(actors), dict(to), len(to))
        assert (r.first_day, r.last_day) == (min(days), max(days))
        assert r.mean_score == pytest.approx(sum(e[3] or 0 for e in mine) / len(mine), abs=0.00501)
        assert r.coherence == pytest.approx(np.mean([c for i, x, c in themes if x == t and i % 9]), abs=1e-6)
    shown = construct.coherent_campaigns(construct.theme_summary(*args, ["the"], 3), 0.5, 12, 4, 3).collect()
    want = sorted((t for t, r in got.items() if r.coherence >= 0.5 and r.n >= 12 and r.n_recipients >= 4), key=lambda t: (-got[t].coherence, t))[:3]
    assert [r.theme for r in shown] == want and want
    for r in shown:
        assert r.dominant == min(r.actors, key=lambda a: (-r.actors[a], a))


def test_blocs_of_planted_profiles(spark):
    rows = [(f"R{i}", lane, (0.8 if lane == f"L{i % 4}" else 0.05) + 0.001 * i) for i in range(20) for lane in ("L0", "L1", "L2", "L3") if lane == f"L{i % 4}" or i % 5]
    df = spark.createDataFrame(rows, "recipient_country string, lane string, share double")
    got = {r.recipient_country: r.bloc for r in construct.recipient_blocs(df).collect()}
    assert len(got) == 20 and len(set(got.values())) == 4
    assert all(got[f"R{i}"] == got[f"R{i % 4}"] for i in range(20))
