"""Keyword search over posting blocks against plain loops."""

import collections
import math
import random
import re

import pytest

from newsgrain.operators import posting_blocks


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def by_loops(queries, docs, weights, k):
    tf, length = {}, {}
    for i, *texts in docs:
        own = [words(t) for t in texts]
        if any(own):
            length[i] = sum(map(len, own))
            tf[i] = collections.Counter()
            for w, ws in zip(weights, own, strict=True):
                for x in ws:
                    tf[i][x] += w
    mean = sum(length.values()) / max(1, len(length))
    df = collections.Counter(x for c in tf.values() for x in c)
    out = set()
    for q, text in queries:
        asked = set(words(text))
        scored = []
        for i, c in tf.items():
            if asked and all(x in c for x in asked):
                s = sum(math.log(1 + (len(tf) - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for x in asked)
                scored.append((-round(s, 6), i))
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize(("size", "most"), [(1024, 1 << 16), (7, 1 << 16), (16, 5)])
def test_block_search(spark, size, most):
    rng = random.Random(4)
    word = lambda: "abcdefghij"[min(9, int(rng.expovariate(0.4)))] * rng.randint(1, 2)
    docs = [(i, None if i % 19 == 0 else " ".join(word() for _ in range(rng.randint(0, 3))), "-".join(word().upper() for _ in range(rng.randint(0, 25)))) for i in range(400)]
    docs += [(1000 + i, "a b", "c d") for i in range(30)] + [(2000, None, None), (2001, "", "é!")]  # ties, and nothing to count
    queries = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(25)] + [(90, ""), (91, None), (92, "nowhere a"), (93, "a b c d"), (94, "A, a; a")]
    df = spark.createDataFrame(docs, "doc_id long, title string, body string").repartition(3)
    got = posting_blocks.block_search(spark.createDataFrame(queries, "query_id long, query string"), df, {"title": 1.0, "body": 0.4}, 5, most=most, size=size)
    want = by_loops(queries, docs, (1.0, 0.4), 5)
    rows = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()}
    assert len(rows) == len(want) > 60 and {(q, i, r): pytest.approx(s, abs=2e-6) for q, i, s, r in want} == {(q, i, r): s for q, i, s, r in rows}


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([("x", "a b"), ("y", None)], "doc_id string, body string")
    queries = spark.createDataFrame([(1, "a"), (2, "")], "query_id long, query string")
    assert [(r.query_id, r.doc_id) for r in posting_blocks.block_search(queries, docs, {"body": 1.0}, 3).collect()] == [(1, "x")]
    assert posting_blocks.block_search(queries.limit(0), docs, {"body": 1.0}, 3).count() == 0
    assert posting_blocks.block_search(queries, docs.limit(0), {"body": 1.0}, 3).count() == 0
