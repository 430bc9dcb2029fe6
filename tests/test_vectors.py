"""Cosine joins and the inverted index against matrices of all cosines."""

import os

import numpy as np
import pytest

from newsgrain.operators import retrieval, tiles
from newsgrain.operators.store import new_dir
from newsgrain.operators.vector_index import VectorIndex


def clustered(n, groups, dims=16, noise=0.15, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] / dims**0.5 + noise * rng.normal(size=(n, dims)) / dims**0.5 * 2


def frame(spark, x, extra=()):
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, kind long, embedding array<double>").repartition(4)


def cosines(x):
    u = np.asarray(x) / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


@pytest.mark.parametrize("block", [["kind"], []])
def test_similar_pairs_with_pruning(spark, block):
    x = clustered(400, 12)
    x[50:80] = x[50]  # copies
    df = frame(spark, x, [(900, 0, None), (901, 0, [0.0] * 16), (902, 1, x[7].tolist())])
    ids, full, kind = [*range(400), 902], cosines(np.concatenate([x, x[7:8]])), [*(i % 2 for i in range(400)), 1]
    want = {(ids[i], ids[j], full[i, j]) for i in range(401) for j in range(i + 1, 401) if full[i, j] >= 0.9 and (not block or kind[i] == kind[j])}
    got = tiles.similar_pairs(df, block, 0.9, size=16).select("a", "b", "cosine").collect()
    assert len(got) == len(want) and {(r.a, r.b, r.cosine) for r in got} == want
    # the same by one tile a block
    assert {(r.a, r.b, r.cosine) for r in tiles.similar_pairs(df, block, 0.9).collect()} == want


def test_tile_pairs_grow_with_the_rows(spark):
    """With as many more clusters as rows, pairs of tiles that are made grow about as the rows do, and all pairs as their square; no pair that is skipped holds a similar pair."""
    made, every = [], []
    for n in (300, 600, 1200):
        x = clustered(n, n // 25, dims=8, noise=0.03)
        rows, stats = tiles.placed(frame(spark, x), [], 8)
        pairs = {(r.i, r.j): r.kept for r in tiles.tile_pairs(stats, [], 0.95).collect()}
        tile = {r.vec_id: r.tile for r in rows.collect()}
        full = cosines(x)
        for i, j in zip(*np.nonzero(np.triu(full >= 0.95)), strict=True):
            a, b = sorted((tile[i], tile[j]))
            assert pairs[a, b]
        assert max(r.n for r in stats.collect()) <= 40
        made.append(sum(pairs.values()))
        every.append(len(pairs))
    assert made[0] < 0.5 * every[0] and every[2] > 9 * every[0] and made[2] < 7 * made[0]


def test_index(spark):
    x = clustered(1500, 30)
    x[100:140] = x[100]
    df = frame(spark, x, [(9000, 0, None)])
    index = VectorIndex.build(df, new_dir(spark, "index"), cells=25, size=32)
    assert index.rows.count() == 1500 and index.rings.groupBy().sum("n").first()[0] == 1500 and 1 <= index.needed(10) <= index.needed(160) <= 25 == index.needed(10, "vec_id < 3")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 50)], "query_id long, q array<double>")
    full = cosines(x)
    exact = {(i, int(j)) for i in range(0, 1500, 50) for j in np.lexsort((np.arange(1500), -full[i]))[:10]}
    rows = index.search(queries, 10).collect()
    got = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(got) == 300 and len(got & exact) >= 0.9 * 300
    assert all(r.score == pytest.approx(full[r.query_id, r.vec_id], abs=2e-6) for r in rows) and sorted(r.rank for r in rows if r.query_id == 50) == list(range(1, 11))
    # all cells: exact, whatever the rings skip
    everything = {(r.query_id, r.vec_id) for r in index.search(queries, 10, probes=25).collect()}
    assert {(q, full[q, v]) for q, v in everything} == {(q, full[q, v]) for q, v in exact}
    again = VectorIndex(spark, index.path)
    assert again.probes == index.probes and {(r.query_id, r.vec_id) for r in again.search(queries, 10).collect()} == got


def test_index_gives_k_rows_under_a_filter(spark):
    x = clustered(600, 20)
    df = frame(spark, x)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 300)] + [(7, None)], "query_id long, q array<double>")
    index = VectorIndex.build(df, new_dir(spark, "index"), cells=24, size=16)
    few = "vec_id % 60 = 5"  # ten rows, strewn over the cells
    for filters, n in ((few, 10), ("vec_id = 3", 1), ("vec_id < 0", 0)):
        got = [(r.query_id, r.vec_id) for r in index.search(queries, 10, filters, probes=1).collect()]
        assert len(got) == len(set(got)) == 2 * n
    want = {(r.query_id, r.vec_id) for r in retrieval.vector_search(queries, df, 10, few).collect()}
    assert {(r.query_id, r.vec_id) for r in retrieval.vector_search(queries, df, 10, few, approx=True, index=index).collect()} == want


def test_index_of_nothing(spark):
    none = frame(spark, np.zeros((0, 4)), [(1, 0, None)])
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, q array<double>")
    assert retrieval.vector_search(queries, none, 3, approx=True).count() == 0
    one = frame(spark, np.ones((1, 4)))
    assert [(r.vec_id, r.score) for r in retrieval.vector_search(queries, one, 3, approx=True).collect()] == [(0, 0.5)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    import __spark_entry__ as entry

    rows = entry.queries()["vector_search_approx"](spark, f"/root/testdata/{sf}").collect()
    assert all(r.n_found == r.n_exact for r in rows)
    assert sum(r.recall for r in rows) / len(rows) >= 0.9
