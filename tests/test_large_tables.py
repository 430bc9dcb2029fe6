"""Steps that grew faster than the input, against plain loops or SQL; each would have failed before."""

import datetime
import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import bundles, construct, graph, posting_blocks, quality, retrieval
from newsgrain.operators.fact_store import FactStore
from newsgrain.operators.names import dedupe_fuzzy_names
from newsgrain.operators.store import children, exists, written
from newsgrain.operators.tiles import similar_pairs
from newsgrain.plans import queries_counts as counts
from newsgrain.plans import queries_more as more
from newsgrain.plans import queries_text as text
from newsgrain.plans import registry
from newsgrain.plans.model import Model

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@given
def test_theme_recipients(spark):
    duck = pytest.importorskip("duckdb").connect()
    t = lambda name: f"read_parquet('{SF}/{name}.parquet')"
    want = duck.execute(f"""SELECT DISTINCT p.p_partkey, n.n_name FROM {t('lineitem')} l JOIN {t('part')} x ON x.p_partkey = l.l_partkey JOIN {t('part')} p ON p.p_name = x.p_name JOIN {t('lineitem')} o ON o.l_orderkey = l.l_orderkey
        JOIN {t('supplier')} s ON s.s_suppkey = o.l_suppkey JOIN {t('nation')} n ON n.n_nationkey = s.s_nationkey WHERE p.p_partkey IN (SELECT vec_id FROM {t('embeddings')})""").fetchall()
    got = [tuple(r) for r in more.theme_recipients(Model(spark, SF)).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want) and want


def test_fits_are_dealt_to_tasks(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    seen = []
    monkeypatch.setattr(KMeans, "fit", lambda self, df, fit=KMeans.fit: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    df = spark.createDataFrame([(i, [float(i % 7 == j) + i / 9999 for j in range(8)]) for i in range(3000)], "vec_id long, embedding array<double>").coalesce(1)
    assert construct.narrative_themes(df, k=4, parts=5).count() == 3000 and seen == [3]


def test_append_of_bucketed_facts(spark, tmp_path):
    spark.range(500).selectExpr("id AS doc_id", "id * 7 AS x").write.parquet(f"file://{tmp_path}/given")
    d = FactStore(spark, f"file://{tmp_path}/facts").whole("d", [f"file://{tmp_path}/given"], lambda: spark.read.parquet(f"file://{tmp_path}/given"), "doc_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a table that is too large to broadcast
    try:
        rows = quality.idempotent_append(d.unionByName(d), d.where("doc_id % 3 = 0"), ["doc_id"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, rows)) == [(i, i * 7) for i in range(500)]


def test_composite_distances_by_tiles(spark):
    rng = random.Random(8)
    rows = [(rng.choice("AB"), i, [rng.gauss(0, 1) for _ in range(4)] if i % 17 else None, rng.sample(range(30), rng.randint(0, 9)) if i % 13 else None, datetime.date(2024, 1, 1) + datetime.timedelta(rng.randint(0, 80))) for i in range(90)]
    df = spark.createDataFrame(rows, "block string, id long, embedding array<double>, docs array<long>, day date")
    want = {}
    for (p, i, u, x, s), (q, j, v, y, t) in itertools.combinations(rows, 2):
        if p == q:
            x, y, gap = set(x or ()), set(y or ()), abs((s - t).days)
            cosine = sum(k * n for k, n in zip(u, v, strict=True)) / math.hypot(*u) / math.hypot(*v) if u and v else 0.0
            want[i, j] = (1.0 if gap > 30 else 0.4 * (1 - cosine) + 0.2 * (1 - (len(x & y) / len(x | y) if x | y else 0.0)) + 0.4 * min(gap / 30, 1)), gap
    for far in (True, False):
        got = {(r.a, r.b): r.distance for r in graph.pairwise_composite_distance(df, far=far, size=7).collect()}
        assert got == {k: pytest.approx(d, abs=1.1e-6) for k, (d, gap) in want.items() if far or gap <= 30}
    # links of tiles are few, and have the components of all pairs at every level
    for cut in (0.55, 1.0):
        links = {(r.a, r.b): r.distance for r in graph.composite_links(df, cut, size=30).collect()}
        near = {k: d for k, d in got.items() if d < cut}
        assert links.items() <= near.items()
        assert cut < 1 or 2 * len(links) < len(near)
        for level in sorted(near.values())[:: 1 + len(near) // 9]:
            assert parts_of(links, level) == parts_of(near, level)


def parts_of(links, level):
    """The node with the least id that each node reaches by links up to a level."""
    out = {i: i for k in links for i in k}
    for _ in out:
        for (a, b), d in links.items():
            if d <= level:
                out[a] = out[b] = min(out[a], out[b])
    return {i: x for i, x in out.items() if i != x}


@given
def test_label_records_are_read_once_in_many_files(spark, monkeypatch):
    from newsgrain.plans import queries_io, registry  # noqa: F401
    from newsgrain.sources import label_records

    files, inputs = [], label_records.read_packed_labels_csv
    monkeypatch.setattr(label_records, "read_packed_labels_csv", lambda s, where: files.extend(children(s, where)) or inputs(s, where))
    m = Model(spark, SF)
    plan = registry.QUERIES["read_packed_labels_csv"](spark, SF)
    tasks = m.d.select("doc_id").rdd.getNumPartitions()
    assert tasks > 1 and sum(f.endswith(".csv") for f in files) == tasks
    assert "FileScan csv" not in plan._jdf.queryExecution().executedPlan().toString()


def test_keyword_search_scores_copies_once(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(1, 4))) for _ in range(12)]
    docs = {i: rng.choice(texts) for i in range(200)}
    asked = {q: " ".join(rng.sample("abcdef", rng.randint(1, 2))) for q in range(30)} | {30: "zz", 31: ""}
    postings = retrieval.build_postings(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", {"text": "B"})
    held = []
    monkeypatch.setattr(retrieval, "written", lambda df, label: held.append(written(df, label)) or held[-1])
    rows = retrieval.keyword_search(spark.createDataFrame(list(asked.items()), "query_id long, query string"), postings, postings.groupBy("doc_id").agg({"tf": "sum"}).toDF("doc_id", "n_tokens"), 5).collect()
    words = {i: t.split() for i, t in docs.items()}
    mean, df = sum(map(len, words.values())) / 200, lambda t: sum(t in w for w in words.values())
    want = []
    for q, text in asked.items():
        need = set(text.split())
        found = {i: round(sum(math.log(1 + (200 - df(t) + 0.5) / (df(t) + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in sorted(need)), 6) for i, w in words.items() if need and need <= set(w)}
        want += [(q, i, found[i], r + 1) for r, i in enumerate(sorted(found, key=lambda i: (-found[i], i))[:5])]
    assert sorted((r.query_id, r.doc_id, pytest.approx(r.score, abs=2e-6), r.rank) for r in rows) == sorted(want)
    kinds = len({tuple(sorted(w)) for w in words.values()})
    assert held[0][0].count() <= 5 * kinds < 200


def test_fuzzy_names_ask_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(rows):
        for r in rows:
            seen.add(1)
            yield r

    names = [(f"name of {i} kinds", i) for i in range(1000, 1060)] + [("altogether else", 9)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(names, 2).mapPartitions(told), "name string, rank long")
    assert sorted(r.rank for r in dedupe_fuzzy_names(df, 0.85).collect()) == [9, 1000]
    assert seen.value == len(names)


@given
def test_late_stream_files_come_from_the_first(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from newsgrain.plans import queries_io, registry  # noqa: F401

    plans = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args, write=DataFrameWriter.parquet, **named: plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()) or write(self, path, *args, **named))
    assert registry.QUERIES["stream_ingest_files"](spark, SF).count() == Model(spark, SF).cat.count()
    late = [p for p in plans if "; late" in p and "LogicalRDD" not in p]
    assert len(late) == 1 and "Aggregate" not in late[0]  # one task writes it, and groups nothing


def shuffles(plan):
    """Exchanges of rows by key in a physical plan."""
    return str(plan._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


@given
def test_facts_are_shuffled_once_and_not_sorted(spark, monkeypatch, tmp_path):
    from pyspark.sql import DataFrameWriter

    plans = []
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda self, *args, write=DataFrameWriter.saveAsTable: plans.append(shuffles(self._df)) or write(self, *args))
    monkeypatch.setattr(DataFrameWriter, "sortBy", lambda self, *columns: pytest.fail("sorted"))
    m = Model(spark, SF)
    m.facts = FactStore(spark, f"file://{tmp_path}/facts")
    assert m.rc.count() == m._rc().distinct().count() < m._rc().count()
    assert m.cat.count() == m._cat().distinct().count() < m._cat().count()
    assert plans == [1, 1]


def test_files_of_records_are_parsed_once(spark, tmp_path):
    from newsgrain.sources import label_records

    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('[[{"id": "3"}], []]')
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text('{"id": "4"}')
    found = label_records.label_files(spark, str(tmp_path))
    assert sorted(r.record for r in found.collect()) == ['{"id": "4"}', '{"id":"1"}', '{"id":"2"}', '{"id":"3"}']
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert not any("from_json" in x for x in filters)


def test_rollup_reads_documents_once_for_its_own_columns(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(rows):
        for r in rows:
            seen.add(1)
            yield r

    rng = random.Random(5)
    day = lambda: datetime.date(2024, rng.randint(1, 3), rng.randint(1, 28))
    docs = {i: (day(), rng.choice(["s", "t", None])) for i in range(60)}
    rows = [(rng.choice("AB") if i % 9 else "C", i, *docs[i]) for i in range(60) for _ in range(2)]
    bridge = [(i, rng.choice("xyz")) for i in range(60)]
    scores = [(k, p, rng.choice([None, 1.0, 2.5, 4.0])) for k in "ABD" for p in ("daily", None) for _ in range(7)]
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).mapPartitions(told), "k string, doc_id long, date date, source_name string")
    out = bundles.rollup(d, ["k"], {"kind": (spark.createDataFrame(bridge, "doc_id long, kind string"), "kind", 2)}, spark.createDataFrame(scores, "k string, period_type string, material_score double"), 10)
    got = {(r.k, r.section, r.key): r.n for r in out.collect()}
    totals = {r.k: (r.n, r.first_day, r.last_day, r.mean_score, r.median_score) for r in out.where("section = 'total'").collect()}
    assert seen.value == 2 * len(rows)  # once for groups, sources and months, once with the bridge
    of = {k: {i for x, i, *_ in rows if x == k} for k in "AB"}
    for k, ids in of.items():
        own, s = [docs[i] for i in ids], sorted(x for y, _, x in scores if y == k and x is not None)
        middle = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        assert totals.pop(k) == (len(ids), min(x for x, _ in own), max(x for x, _ in own), pytest.approx(sum(s) / len(s), abs=1e-6), middle)
        for name in "st":
            assert got.get((k, "source", name), 0) == sum(x == name for _, x in own)
        for month in (1, 2, 3):
            assert got.get((k, "month", f"2024-0{month}"), 0) == sum(x.month == month for x, _ in own)
        kinds = sorted(((-sum(b == kind and i in ids for i, b in bridge), kind) for kind in "xyz"))[:2]
        assert {(x[2], n) for x, n in got.items() if x[:2] == (k, "kind")} == {(kind, -n) for n, kind in kinds if n}
        assert got[k, "events", "daily"] == 7 and sum(n for x, n in got.items() if x[:2] == (k, "score")) == len(s)
    assert not totals


def test_counts_of_blocks_take_no_more_than_the_batch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    terms, ends = [list(range(i, 30000, 3)) for i in range(3)] * 10, [list(range(1, 10001))] * 30
    batch = pa.record_batch({"terms": pa.array([*terms, []], pa.list_(pa.int32())), "ends": pa.array([*ends, []], pa.list_(pa.int64()))})
    total = np.zeros(30000, np.int64)
    tracemalloc.start()
    posting_blocks.add_counts(total, batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total == 10).all() and most < batch.nbytes


def test_components_take_few_pairs_of_a_tile(spark):
    rng = random.Random(2)
    rows = [(rng.choice("AB"), i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "block string, vec_id long, embedding array<double>")
    for size in (16, 1024):
        every = [(r.a, r.b) for r in similar_pairs(df, ["block"], 0.9, size).collect()]
        few = [(r.a, r.b) for r in similar_pairs(df, ["block"], 0.9, size, links=True).collect()]
        assert set(few) <= set(every) and len(few) == len(set(few)) and all(a < b for a, b in few)
        assert parts_of(dict.fromkeys(few, 0), 0) == parts_of(dict.fromkeys(every, 0), 0)
    assert len(few) < len(rows) < len(every)


@given
def test_mentions_lie_by_document(spark):
    m = Model(spark, SF)
    assert shuffles(m.event_docs) == shuffles(m.den) == 0
    assert m.event_docs.count() == m._dem_docs().select("canonical_event_id", "mention_date", "doc_id").distinct().count()


def test_weights_of_edges_without_their_documents(spark):
    rng = random.Random(4)
    den = spark.createDataFrame([(rng.choice("AB"), rng.choice("pqrstuvw"), rng.randint(1, 40)) for _ in range(300)], "initiating_country string, entity string, doc_id long")
    d = spark.createDataFrame([(i, datetime.date(2024, 1, 1)) for i in range(1, 41)], "doc_id long, date date")
    cat = spark.createDataFrame([(i, "x") for i in range(1, 41, 2)], "doc_id long, category string")
    want = {(r.initiating_country, r.a, r.b): r.weight for r in graph.entity_cooccurrence(den, d, cat).collect()}
    got = graph.entity_weights(den, tile=3)
    assert {(r.initiating_country, r.a, r.b): r.weight for r in got.collect()} == want and want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


@given
def test_partner_report_takes_no_facts_of_all_documents(spark, tmp_path):
    where = f"file://{tmp_path}/sf"
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    m = Model(spark, where)
    got = counts.partner(m)
    assert counts.P.framing_share(got, 3).count() > 0 and not exists(spark, m.facts.path)
    # the same rows as from facts, and each line's names once
    want = counts.both(m)
    assert want.count() == got.count() > 0 and got.exceptAll(want).isEmpty()


@given
def test_day_pack_takes_numbers_for_names(spark, tmp_path):
    where = f"file://{tmp_path}/sf"
    for t in ("customer", "supplier", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    # names on both sides of ZZZ, missing ones, and documents without lines
    spark.read.parquet(f"{SF}/nation.parquet").withColumn("n_name", F.expr("CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'ZZZ' ELSE n_name END")).write.parquet(f"{where}/nation.parquet")
    spark.read.parquet(f"{SF}/part.parquet").withColumn("p_type", F.expr("CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'zz' ELSE p_type END")).write.parquet(f"{where}/part.parquet")
    m = Model(spark, where)
    got = text.day_pack(m)
    assert not exists(spark, m.facts.path)
    assert "SortAggregate" not in got._jdf.queryExecution().toString()
    duck = pytest.importorskip("duckdb").connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/sf/{t}.parquet/*.parquet')")
    want = duck.execute(registry.SQL["document_day_pack"]).fetchall()
    assert sorted((r.date, r.doc_id, r.chunk) for r in got.collect()) == sorted(want) and want


def test_files_of_distances_are_small(spark, tmp_path):
    rng, n = random.Random(11), 3000
    df = spark.createDataFrame([("A", 7 * i, [rng.gauss(0, 1) for _ in range(32)], rng.sample(range(400), 5), datetime.date(2024, 1, 1) + datetime.timedelta(i % 50)) for i in range(n)], "block string, id long, embedding array<double>, docs array<long>, day date")
    graph.pairwise_composite_distance(df, size=4096).write.parquet(f"file://{tmp_path}/pairs")
    assert spark.read.parquet(f"file://{tmp_path}/pairs").count() == n * (n - 1) / 2
    size = sum(os.path.getsize(tmp_path / "pairs" / f) for f in os.listdir(tmp_path / "pairs") if f.endswith(".parquet"))
    assert size < 5.5 * n * (n - 1) / 2  # a pair is three numbers of eight bytes
    # of a large block an event goes to few tiles
    assert graph._tiled(df, 30, True, 10, 80).count() == n * 38


def test_pairs_of_tiles_by_chunks():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    for alone, text, far in itertools.product((True, False), (True, False), (True, False)):
        rows = []
        for k in range(70):
            u = [rng.gauss(0, 1) for _ in range(rng.choice([3, 4]))] if k % 11 else rng.choice([None, [0.0, 0.0, 0.0], [math.inf, 1.0, 0.0]])
            rows.append((rng.randint(0, 60), u, rng.sample(range(20), rng.randint(0, 6)) if k % 13 else None, rng.randint(0, 70) if k % 17 else None, alone or k % 3 == 0))
        name = (lambda i: f"n{i:02d}") if text else (lambda i: i)
        t = pa.table({"id": pa.array([name(r[0]) for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "docs": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "day": pa.array([r[3] for r in rows], pa.int32()), "_left": pa.array([r[4] for r in rows]), "_i": [0] * 70, "_j": [0 if alone else 1] * 70})
        want = []
        for (i, u, x, s, mine), (j, v, y, e, other) in itertools.combinations(rows, 2):
            gap = abs(s - e) if s is not None and e is not None else None
            if i == j or not alone and mine == other or not far and (gap is None or gap > 30):
                continue  # an event with itself, tiles with themselves
            x, y, d = set(x or ()), set(y or ()), math.nan
            if gap is not None and gap > 30:
                d = 1.0
            elif not any(math.inf in (w or ()) for w in (u, v)):
                cosine = sum(k * n for k, n in zip(u, v, strict=False)) / math.hypot(*u) / math.hypot(*v) if any(u or ()) and any(v or ()) else 0.0
                d = 0.4 * (1 - cosine) + 0.2 * (1 - (len(x & y) / len(x | y) if x | y else 0.0)) + 0.4 * (1.0 if gap is None else gap / 30)
            want.append((name(min(i, j)), name(max(i, j)), d))
        got = [b.to_pydict() for b in graph.composite_pairs(t, (0.4, 0.2, 0.4), 30, far, chunk=9, strip=4, few=2, most=5)]
        assert max(len(b["a"]) for b in got) <= 5
        got = [x for b in got for x in zip(b["a"], b["b"], b["distance"], strict=True)]
        key = lambda r: (r[0], r[1], math.isnan(r[2]), r[2])
        assert [r[:2] for r in sorted(got, key=key)] == [r[:2] for r in sorted(want, key=key)]
        assert np.allclose([r[2] for r in sorted(got, key=key)], [r[2] for r in sorted(want, key=key)], atol=1.1e-6, rtol=0, equal_nan=True)
