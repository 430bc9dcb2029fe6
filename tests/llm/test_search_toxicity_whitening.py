"""Lexical search, toxicity and whitening: against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrain.llm import lexical_search, toxicity, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, term string, bag int, hash string, m int, score string, toxic string, row int"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "h", 2, "s", "t", 3) for i, t in rows], DOCS).repartition(3)


def ranked(docs, items, k=10):
    docs = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    total, df = sum(sum(c.values()) for _, c in docs), collections.Counter(w for _, c in docs for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for at, (i, c) in enumerate(docs):
            m = 10 + (90 * sum(c.values()) * len(docs)) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if c[w])
            scores += [(-s, i is None, i or 0, at, i)] if s > 0 else []
        out += [(item, r + 1, x[-1], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


SOME = [
    (1, "the cat sat on the mat"), (2, "THE CAT sat; on the mat"), (2, "the cat sat on the mat"), (None, "the cat sat on the mat"), (4, None), (5, ""), (6, " .,!\n\t"), (7, "Été à côté 中文 x1"), (8, "été à CÔTÉ 中文 x1"),
    (9, "cat " * 5000), (10, " ".join(f"w{i}" for i in range(20000)) + " cat mat"), (11, "nul\x00cat\x7fmat"), (12, "dog"),
]
ITEMS = [(1, "The cat, the mat"), (2, None), (3, "..."), (4, "nothing-here absent"), (5, "côté 中文"), (6, "dog cat"), (6, "x1"), (None, "mat"), (8, "Cat cat CAT")]


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_search(spark, most):
    many = SOME + [(100 + i, "the cat sat on the mat") for i in range(60)] + [(200 + i, f"cat and {i % 7} mats") for i in range(60)]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, term string")
    got = lexical_search.lexical_search(table(spark, many), items, most=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(many, ITEMS)


def test_search_random(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(500)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 6)))) for i in range(40)]
    got = lexical_search.lexical_search(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, 7)


def test_search_empty(spark):
    none, items = table(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.lexical_search(none, items).count() == 0
    assert lexical_search.lexical_search(table(spark, SOME), items.limit(0)).count() == 0


def test_scores_are_exact_beyond_doubles(spark):
    """A weight far above any real one: the halves that are added up keep every bit."""
    classes = spark.createDataFrame([([0, 3, 1, 1], 90, 5, [(5, 5)])], "bag array<int>, m long, first long, docs array<struct<last:long,doc_id:long>>")
    row = lexical_search.scored(classes, np.array([(1 << 43) + 1, 12345], np.int64), [[0], [0]], 10).first()
    assert row.score == ((1 << 43) + 1) * (3 * 10**9 // (3000 + 720)) + 12345 * (10**9 // (1000 + 720))


def plain_ratio(ordinary, toxic):
    """Log of toxic over ordinary probability of a term's bytes, by dictionaries."""
    def strings(word):
        b = b" " + word + b" "
        return [b[max(0, i - 5) : i + 1] for i in range(1, len(b))]

    counts = [collections.Counter(g for w in words for g in strings(w)) for words in (ordinary, toxic)]
    every = {g[i:] for c in counts for g in c for i in range(len(g))}
    before = collections.Counter(g[1:] for g in every if len(g) > 1)

    def off(values):
        once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return once / (once + 2 * twice) if once and twice else 0.5

    discount = {n: off([v for g, v in before.items() if len(g) == n]) for n in range(1, 6)}

    def shared(g):
        if not g:
            return 1 / 257
        own = [v for x, v in before.items() if len(x) == len(g) and x[:-1] == g[:-1]]
        return (max(before[g] - discount[len(g)], 0) + discount[len(g)] * len(own) * shared(g[1:])) / sum(own) if own else shared(g[1:])

    own_off = [off(c.values()) for c in counts]

    def p(k, g):
        own = [v for x, v in counts[k].items() if x[:-1] == g[:-1]]
        return (max(counts[k][g] - own_off[k], 0) + own_off[k] * len(own) * shared(g[1:])) / sum(own) if own else shared(g[1:])

    return lambda word: sum(math.log(p(1, g) / p(0, g)) for g in strings(word))


def test_kneser_ney():
    rng = random.Random(3)
    syllables = [b"ba", b"do", b"ri", b"ke", b"lu", "é".encode()]
    word = lambda: b"".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    ordinary, toxic = [word() for _ in range(300)], [word() for _ in range(200)] + [b"zot", b"zotli", b"zotba"] * 4
    ratio = plain_ratio(ordinary, toxic)
    found = [toxicity.terms(np.frombuffer(b" ".join(x), np.uint8), np.array([0, len(b" ".join(x))])) for x in (ordinary, toxic)]
    keys = np.unique(np.concatenate([f[3] for f in found]))
    counts = np.stack([np.bincount(np.searchsorted(keys, f[3]), f[0][f[4]], len(keys)) for f in found], axis=1)
    model = toxicity.ratios(keys, counts)
    for text in (b"ba", b"zot", b"zotdo", b"BADO", b"qqq", b"lu lu zotli", b"", b"keri kelu dodo zotzot"):
        each = [math.log1p(0.01 * math.expm1(min(ratio(w.lower()), 80))) for w in text.split()]
        got = toxicity.differences(model, 0.01, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert got[0] == pytest.approx(sum(each) / max(1, len(each)), rel=1e-4, abs=1e-6)


def toxic_docs(n, seed=1):
    """Texts of made-up words, every fifth with a few terms of two stems that ordinary ones don't have."""
    rng = random.Random(seed)
    part = ["an", "ore", "ti", "the", "sha", "in", "ed", "lo", "mur", "be"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grzk", "vux"]) + word())
        out.append((i, " ".join(words).capitalize() + "."))
    return out


def test_toxicity(spark):
    rows = toxic_docs(800)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 7, "t") for i, _ in rows if i % 3], "doc_id long, toxic int, score int, text string")
    odd = [(None, None), (None, rows[0][1]), (2000, ""), (2001, None), (2002, " ,.!"), (0, rows[0][1]), (2003, rows[5][1] * 400), (2004, rows[1][1] * 400)]
    got = collections.defaultdict(list)
    for r in toxicity.toxicity(table(spark, rows + odd), labels).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows) + len(odd)
    for i, group in got.items():
        assert {r.held_out for r in group} == {i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in group)
    held = [(i % 5 == 0, got[i][0].predicted) for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(t == p for t, p in held) >= 0.98 * len(held)
    assert len({r.score for r in got[0]} | {r.score for r in got[None] if r.predicted}) == 1  # equal texts, equal scores
    assert got[2000][0].score == got[2001][0].score == got[2002][0].score < 0.3
    assert got[2003][0].predicted == 1 and got[2004][0].predicted == 0


def test_held_out_labels_are_not_learnt(spark):
    rows = toxic_docs(300)
    docs, held = table(spark, rows), lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    label = lambda flip: spark.createDataFrame([(i, int(i % 5 == 0) ^ int(flip and held(i))) for i, _ in rows], "doc_id long, toxic int")
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, label(flip)).collect())) for flip in (False, True))
    assert a == b


def test_toxicity_without_a_class(spark):
    docs = table(spark, toxic_docs(20))
    for label, score in ((0, 0.0), (1, 1.0), (None, 0.0)):
        labels = spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, toxic int")
        assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {score}
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def plain_whitening(rows, k=16):
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in good]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return [(i, n, sum(int(y) ** 2 for y in n * np.array(r, object) - total), ((n * np.array(r, object) - total).astype(float) / n @ v)[:k] / np.sqrt(e[:k]), e[:k] / e.sum()) for (i, _), r in zip(good, x, strict=True)]


VEC = "vec_id long, embedding array<float>, x string, component string, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c", 1) for i, v in rows], VEC).repartition(5)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    data = [(i, (rng.normal(size=20) * np.linspace(1, 4, 20)).tolist()) for i in range(400)]
    rows = data + [(7, data[7][1]), (None, data[8][1]), (500, None), (501, [None] * 20), (502, [float("nan")] * 20), (503, [float("inf")] + [0.0] * 19), (504, []), (505, [1.0] * 3)] + [(600 + i, data[0][1]) for i in range(300)]
    want = plain_whitening([r for r in rows if r[0] != 505])
    got = collections.defaultdict(list)
    for r in whitening.whitening(vectors(spark, rows)).collect():
        got[r.vec_id].append(r)
    assert {i: len(v) for i, v in got.items()} == {i: 16 * n for i, n in collections.Counter(w[0] for w in want).items()}
    flip = {}
    for i, n, deviation, white, explained in want:
        for r in got[i]:
            j = r.component - 1
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained[j], rel=1e-9) and r.identity_error < 1e-9
            sign = flip.setdefault(j, 1 if r.whitened * white[j] > 0 else -1)
            assert sign * r.whitened == pytest.approx(white[j], abs=1e-7)


def test_whitening_without_variance(spark):
    few = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 2.0, 3.0])]
    rows = {(r.vec_id, r.component): r for r in whitening.whitening(vectors(spark, few)).collect()}
    assert len(rows) == 9 and rows[1, 1].n == 2 and abs(rows[3, 1].whitened) == pytest.approx(1) and rows[3, 1].whitened == -rows[1, 1].whitened
    assert rows[1, 2].whitened is None and rows[1, 2].explained == 0 and rows[1, 1].explained == pytest.approx(1) and rows[1, 1].identity_error < 1e-9
    one = whitening.whitening(vectors(spark, few[:2])).collect()
    assert len(one) == 6 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, None, None, 0)}
    assert whitening.whitening(vectors(spark, [])).count() == 0 and whitening.whitening(vectors(spark, [(1, None)])).count() == 0


def test_large_entries(spark):
    big = [(i, [float(2**49 - 2**30 * i), 1.0]) for i in range(3)] + [(9, [float(2**50), 1.0])]
    rows = whitening.whitening(vectors(spark, big)).where("component = 1").collect()
    want = {w[0]: w[2] for w in plain_whitening(big[:3])}
    assert {r.vec_id: r.deviation for r in rows} == {i: d if d < 2**63 else None for i, d in want.items()}


@pytest.mark.parametrize("shape", ["plain", "graded", "low rank", "equal", "two values", "wide"])
def test_singular_values(shape):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(90, 24)))[0]
    x = {"plain": rng.normal(size=(90, 24)), "graded": rng.normal(size=(90, 24)) * np.logspace(0, -7, 24), "low rank": rng.normal(size=(9, 24)), "equal": q, "two values": q * np.r_[np.full(12, 2), np.ones(12)], "wide": rng.normal(size=(300, 200))}[shape]
    r = np.zeros((x.shape[1],) * 2)
    top = np.linalg.qr(x, mode="r")
    r[: len(top)] = top
    values, z = whitening.singular(r, 16)
    want = np.zeros(len(values))
    own = np.linalg.svd(x, compute_uv=False)
    want[: len(own)] = own**2
    assert values == pytest.approx(want, rel=1e-10, abs=want[0] * 1e-25)
    assert np.abs(z.T @ z - np.eye(16)).max() < 1e-12
    assert np.linalg.norm(x.T @ (x @ z) - z * values[:16], axis=0).max() < 1e-12 * want[0]


def test_triangles_in_a_tree(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, size=(700, 5)) + 1_000_000
    fit = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(40)
    n, total = whitening.sums(fit, 5)
    assert (n, total) == (700, x.sum(axis=0).tolist())
    r, c = whitening.triangle(fit, n, total), x - x.mean(axis=0)
    assert r.T @ r == pytest.approx(c.T @ c, rel=1e-10, abs=1e-6)


def test_queries_of_the_given_tables(spark):
    """The registered queries on the smallest tables: search against the loops above, whitening against eigh, toxicity on held-out labels."""
    from newsgrain.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    assert sorted(map(tuple, QUERIES["op11_lexical_search"](spark, sf).collect()), key=repr) == ranked(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    want = {w[0]: w for w in plain_whitening(read("embeddings", "vec_id", "embedding"))}
    for r in QUERIES["op13_embedding_whitening"](spark, sf).collect():
        _, n, deviation, white, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), abs=1e-6) and r.explained == pytest.approx(explained[r.component - 1], rel=1e-6)
    assert QUERIES["op12_toxicity"](spark, sf).where(F.col("score").between(0, 1)).count() == len(read("documents", "doc_id"))


def test_toxicity_of_held_out_documents(spark):
    """On the middle tables, where English documents are marked by words: nearly no ordinary document is called toxic, and English toxic ones are found."""
    from newsgrain.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("labels", "documents"))
    got = QUERIES["op12_toxicity"](spark, sf).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rate = {(r.toxic, r.lang == "en"): (r.p, r.n) for r in got.groupBy("toxic", (F.col("lang") == "en").alias("lang")).agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).withColumn("lang", F.when(F.col("lang"), "en").otherwise("x")).collect()}
    assert rate[1, True][0] > 0.9 and rate[0, True][0] < 0.02 and rate[0, False][0] < 0.02
