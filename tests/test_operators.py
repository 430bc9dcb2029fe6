"""Operators on hand-made frames with results worked out by hand."""

import collections
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from newsgrain.functions import columns as C
from newsgrain.operators import construct, facts, graph, names, quality, retrieval, series, tiles
from newsgrain.plans import queries_text, registry  # noqa: F401
from newsgrain.sources import label_records, readers, writers
from newsgrain.streaming import jobs


def days(*ns):
    return [dt.date(2024, 1, 1) + dt.timedelta(n) for n in ns]


def test_split_by_gap(spark):
    # the block {80} is under three rows and joins the one before
    assert series.split_blocks(days(1, 2, 3, 40, 41, 42, 80)) == [0, 0, 0, 1, 1, 1, 1]
    # a short first block joins the next
    assert series.split_blocks(days(1, 40, 41, 42)) == [0, 0, 0, 0]
    # over 180 days: windows of 90 from each window's first row
    assert series.split_blocks(days(*range(0, 220, 20))) == [0] * 5 + [1] * 5 + [2]
    df = spark.createDataFrame([(7, d) for d in days(42, 1, 2, 3, 40, 41, 80)], "canonical_event_id long, mention_date date")
    assert [r.block for r in series.split_by_gap(df).orderBy("mention_date").collect()] == [0, 0, 0, 1, 1, 1, 1]


def test_split_by_gap_as_the_plain_walk(spark):
    import random

    rng, rows = random.Random(3), []
    for event in range(120):
        # gaps near the limit of thirty, dense stretches, and spans of several windows; some days twice
        at, mine = 0, []
        for _ in range(rng.randint(1, 40)):
            at += rng.choice([0, 1, 1, 2, 7, 15, 29, 29, 30, 31, 70])
            mine.append(at)
        rows += [(event, d) for d in days(*mine)]
    want = []
    for event in range(120):
        mine = sorted(d for e, d in rows if e == event)
        want += [(event, d, b) for d, b in zip(mine, series.split_blocks(mine), strict=True)]
    assert max(b for _, _, b in want) > 5
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (0, None), (None, days(5)[0])], "canonical_event_id long, mention_date date")
    got = [tuple(r) for r in series.split_by_gap(df).collect()]
    assert sorted(got, key=repr) == sorted([*want, (None, days(5)[0], 0)], key=repr)
    assert series.split_by_gap(df.where("false")).collect() == []
    plan = series.split_by_gap(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Pandas" not in plan


def test_changepoints_of_random_series(spark):
    """All series in one plan against the loop of one; and several cuts keep the means of the segment that was cut."""
    rng = random.Random(8)
    series_of = {}
    for k in range(40):
        level, ys = rng.choice([2, 10, 30]), []
        for _ in range(rng.randint(1, 40)):
            level = rng.choice([2, 10, 30, 60]) if rng.random() < 0.12 else level
            ys.append(float(level + rng.randint(0, 3)))
        series_of[k] = ys
    series_of[90], series_of[91] = [5.0] * 12, [1.0] * 6 + [9.0] * 6 + [1.0] * 6 + [9.0] * 5 + [8.0]
    month = lambda i: dt.date(2010 + i // 12, i % 12 + 1, 1)
    df = spark.createDataFrame([(k, month(i), y) for k, ys in series_of.items() for i, y in enumerate(ys)], "k long, month date, y double")
    got = {(r.k, r.cp_month): (r.pre_mean, r.post_mean, r.direction, r.z) for r in series.changepoints(df, ["k"]).collect()}
    want = {(k, month(t)): (pre, post, "surge" if post > pre else "decline", z) for k, ys in series_of.items() if sum(ys) >= 50 for t, pre, post, z in series.binseg(ys)}
    assert got.keys() == want.keys() and len(want) > 40 and max(collections.Counter(k for k, _ in want).values()) == 3
    for key, (pre, post, direction, z) in want.items():
        assert got[key][:2] == pytest.approx((pre, post), abs=0.0501) and got[key][2] == direction and got[key][3] == pytest.approx(z, abs=0.00501)


@pytest.mark.parametrize("tile", [256, 3])
def test_cooccurrence_of_crowded_documents(spark, tile):
    rng = random.Random(2)
    docs = {i: [f"e{x}" for x in rng.sample(range(30), n)] for i, n in enumerate([25, 12, 7, 3, 2, 1, 28] + [4] * 40)}
    den = spark.createDataFrame([("c" if i % 2 else "d", x, i) for i, xs in docs.items() for x in xs] * 2, "initiating_country string, entity string, doc_id long").repartition(3)
    d = spark.createDataFrame([(i, dt.date(2024, 1, 1) + dt.timedelta(i)) for i in docs], "doc_id long, date date")
    cat = spark.createDataFrame([(i, f"k{i % 3}") for i in docs], "doc_id long, category string")
    pairs = collections.defaultdict(list)
    for i, xs in docs.items():
        for a in xs:
            for b in xs:
                if a < b:
                    pairs["c" if i % 2 else "d", a, b].append(i)
    want = {k: (len(v), sorted(v)[:4]) for k, v in pairs.items() if len(v) >= 2}
    got = graph.entity_cooccurrence(den, d, cat, most_docs=4, tile=tile).collect()
    assert {(r.initiating_country, r.a, r.b): (r.weight, r.doc_ids) for r in got} == want and len(got) == len(want) > 100
    for r in got:
        assert (r.first_day, r.last_day) == (dt.date(2024, 1, 1) + dt.timedelta(min(r.doc_ids)), dt.date(2024, 1, 1) + dt.timedelta(max(r.doc_ids)))
        assert r.categories == collections.Counter(f"k{i % 3}" for i in r.doc_ids)
    held = graph.entity_pairs(den.distinct(), tile)
    assert held.count() == held.distinct().count() == sum(map(len, pairs.values()))


def test_changepoints_step(spark):
    y = [10.0 + (i % 2) for i in range(12)] + [40.0 + (i % 2) for i in range(11)]
    (found,) = series.binseg(y)
    assert found[0] == 12 and found[1] < 11 and found[2] > 40
    rows = [("a", dt.date(2023 + i // 12, 1 + i % 12, 1), v) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, month date, y double")
    (r,) = series.changepoints(df, ["k"]).collect()
    assert r.direction == "surge" and r.cp_month == dt.date(2024, 1, 1)
    (s,) = series.changepoint_scan(df, ["k"]).collect()
    assert s.cp_month == dt.date(2024, 1, 1) and s.z == pytest.approx(found[3], abs=1e-4)


def test_rolling_zscore_needs_seven_rows(spark):
    df = spark.createDataFrame([("a", d, n) for d, n in zip(days(*range(6)), (1, 1, 1, 1, 1, 90), strict=True)], "k string, day date, n_docs long")
    assert all(r.z == 0 and not r.flag and r.expected is None for r in series.rolling_zscore(df, ["k"]).collect())


def test_alert_needs_deviation(spark):
    df = spark.createDataFrame([(d, 5) for d in days(*range(5))], "day date, n long")
    assert series.alert_surge(df, "n", "2024-01-05").count() == 0


def test_cooldown(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t + dt.timedelta(minutes=m)) for m in (0, 10, 59, 60, 61, 130)], "rule_id long, at timestamp")
    assert [r.at.hour * 60 + r.at.minute for r in series.alert_cooldown(df, 60).orderBy("at").collect()] == [0, 60, 130]


def test_cooldown_streams_a_long_rule(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(r, t + dt.timedelta(minutes=7 * i % 1000)) for r in (None, 1, 2**60, 2**60 + 1) for i in range(300)] + [(5, None), (5, None), (1, None)]
    want = []
    for r in {r for r, _ in rows}:
        last = None
        for a in sorted(a for q, a in rows if q == r and a):
            if last is None or a - last >= dt.timedelta(minutes=60):
                want.append((r, last := a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r) for r in series.alert_cooldown(spark.createDataFrame(rows, "rule_id long, at timestamp"), 60).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, got)) == sorted(map(repr, [*want, (5, None)]))


def test_clusters_are_components(spark):
    v = lambda a: [float(x) for x in a]
    df = spark.createDataFrame([(1, v((1, 0)), "x"), (2, v((0.95, 0.3122)), "x"), (3, v((0.8, 0.6)), "x"), (4, v((-1, 0)), "x")], "vec_id long, embedding array<double>, day string")
    got = {r.vec_id: r.cluster for r in graph.cluster_by_cosine(df, ["day"], 0.94).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_betweenness_of_a_path(spark):
    df = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c")], "actor string, a string, b string")
    assert {r.node: r.betweenness for r in graph.ego_subgraph_betweenness(df, "actor").collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_rerank_pins_the_first(spark):
    df = spark.createDataFrame([("q", i, i, float(i)) for i in range(1, 11)], "query_id string, doc_id long, rank int, rerank_score double")
    got = {r.doc_id: r.place for r in retrieval.rerank_fusion(df, "doc_id").collect()}
    assert got[1] <= 3 and sorted(got.values()) == list(range(1, 11))


def test_null_geofocus(spark):
    df = spark.createDataFrame([(1, "NATION_1", "N2", "c", dt.date(2024, 1, 1), None, None, "s"), (2, "NATION_1", "N2", "c", dt.date(2024, 1, 1), True, False, "s"), (3, "NATION_1", "N2", "c", dt.date(2024, 1, 1), False, False, "t")], "doc_id long, initiating_country string, recipient_country string, category string, month date, self_reported boolean, recipient_focused boolean, source_name string")
    (a,) = facts.provenance_intensity(df).collect()
    (b,) = facts.provenance_intensity(df, "third_party").collect()
    assert (a.raw_docs, a.self_docs, a.third_docs, b.third_docs) == (3, 1, 1, 2)


def test_expressions(spark):
    df = spark.createDataFrame([("2024-05-06T10:00:00Z", " a; b ;;a", "N/A", "word two", "two words", {"x": 2, "a": 2, "z": 1})], "d string, l string, n string, p string, q string, m map<string,bigint>")
    r = df.select(
        C.parse_flexible_date(F.col("d")).alias("d"), C.split_multi(F.col("l")).alias("l"), C.normalize_na(F.col("n")).alias("n"), C.trigram_similarity(F.col("p"), F.col("q")).alias("t"), C.dominant_key(F.col("m")).alias("m"),
        C.clean_subcategory(F.lit("C. Other-Trade")).alias("s"), C.normalize_event_name(F.lit("The 3rd Trade Summit!")).alias("e"), C.self_reported(F.lit("Romania"), F.lit("Oman")).alias("o"), C.iso_week_start(F.lit("2024-W01")).alias("w"),
    ).first()
    assert (r.d, r.l, r.n, r.m, r.s, r.e, r.o, r.w) == (dt.date(2024, 5, 6), ["a", "b", "a"], None, "a", "Trade", "the trade", True, dt.date(2024, 1, 1))
    assert r.t == pytest.approx(8 / 11)


def test_read_articles_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿ATOM ID,Title,BODY,Source Name,"Source Date, Start",Collection Name\n1,T,one,S,2024-01-02,c\n2,T,again,S,2024-01-02,c\n3,U,,S,2024-01-02,c\n4,V,"two\nlines",S,03/04/2024,c\n5,T,other,S,x,d\n', encoding="utf-8")
    got = {r.doc_id: (r.body, r.date) for r in readers.read_articles_csv(spark, str(tmp_path), "c").collect()}
    assert got == {"1": ("one", dt.date(2024, 1, 2)), "4": ("two lines", dt.date(2024, 3, 4))}


def test_packed_labels(spark):
    rows = [
        ("1", "why | salience-bool | category | other | event-name", "because | TRUE | Economic | x | never"), ("2", "salience-bool | category", "TRUE"), ("3", "category", "x"), ("4", None, None),
        ("5", "salience | salience-justification | salience-bool | category | event-name | category", "true | since | TRUE | A | N/A | B"), ("6", "category | salience-bool | category", "out | TRUE | in"), ("7", "salience-bool", "FALSE"),
    ]
    ok, bad = label_records.read_packed_labels(spark.createDataFrame(rows, "id string, types string, values string"))
    got = {r.id: (r.salience, r.salience_justification, r.salience_bool, r.category, r.event_name) for r in ok.collect()}
    assert got == {"1": (None, None, "TRUE", "Economic", None), "5": ("true", "since", "TRUE", "B", None), "6": (None, None, "TRUE", "in", None), "7": (None, None, "FALSE", None, None)}
    assert {b.id: b.reason for b in bad.collect()} == {"2": "token mismatch", "3": "no extraction pass", "4": "no extraction pass"}


def test_packed_export(spark, tmp_path):
    head = "\ufeffATOM ID,Title,Source Name,\"Source Date, Start\",\"Auto GAI, Value\",\"Auto GAI, Value Type\",\"Auto GAI, Model Version\",\"Machine Translations, Title, Text\"\n"
    full = "true | TRUE | Social | P,salience | salience-bool | category | projects,m1 | m2"
    (tmp_path / "a.csv").write_text(f"{head}1,T,S,2024-02-03,{full},Translated\n1,T,S,2024-02-03,{full},\n2,nan,,2024-02-03T10:00:00Z,TRUE,salience-bool,m1,\n,T,S,2024-02-03,{full},\n4,T,S,,{full},\n5,T,S,yesterday,{full},\n", encoding="utf-8")
    ok, bad = label_records.read_packed_labels_csv(spark, str(tmp_path))
    got = {r.doc_id: (r.title, r.source_name, r.date, r.salience, r.category, r.event_name, r.projects, r.project_name, r.gai_engine, r.source_location) for r in ok.collect()}
    day = dt.date(2024, 2, 3)
    assert got == {"1": ("Translated", "S", day, "true", "Social", "P", "P", None, "m2", "None Specified"), "2": ("Default Title", None, day, None, None, None, None, None, "m1", "None Specified")}
    assert sorted((str(b.doc_id), b.reason) for b in bad.collect()) == [("1", "duplicate doc_id within file"), ("4", "missing Source Date, Start"), ("5", "unreadable date"), ("None", "missing ATOM ID")]


def record(i, labels, **more):
    one = {"modelVersion": "v", "filter": {"identifier": "p", "version": 3}}
    return {"id": i, "title": {"title": "T"}, "source": {"name": {"transliterated": "S"}, "startDate": "2024-02-03", "country": {"physical": "here"}}, "custom": {"atom": {"collection_name": "c"}}, "auto": {"gai": [one, one | {"value": [{"type": t, "value": v} for t, v in labels]}]}} | more


def test_label_json(spark, tmp_path):
    twice = record("x", [("category", "old"), ("project-name", "P"), ("event-name", "N/A"), ("category", "Social"), ("source-name", "Other"), ("unknown", "u")])
    files = {
        "single.json": record("one", [("event-name", " E ")], title={}),
        "list.json": [twice, record("x", []), record("y", [("category", None)], machineTranslations={"title_title": {"text": "M"}}), 5, {"id": "z", "auto": {"gai": [{}]}}, {}],
        "nested.json": [[record("n1", [("projects", "Q")])], [record("n2", []), record("n1", [])]],
        "mixed.json": [[record("no", [])], record("mixed", [])],
        "bad.json": [record("d", [], source={"name": {"transliterated": "S"}, "startDate": "soon"}), record("s", [], source={"startDate": "2024-02-03"}), record("t", [(None, "v")]), record("c", [], custom={})],
    }
    for name, what in files.items():
        (tmp_path / name).write_text(json.dumps(what, indent=1))
    (tmp_path / "broken.json").write_text('[{"id": "q"')
    ok, bad = label_records.read_label_json(spark, str(tmp_path))
    got = {r.doc_id: (r.title, r.source_name, r.category, r.event_name, r.project_name, r.projects) for r in ok.collect()}
    assert got == {"one": ("Default Title", "S", None, "E", None, None), "x": ("T", "Other", "Social", "P", "P", None), "y": ("M", "S", None, None, None, None), "n1": ("T", "S", None, "Q", None, "Q"), "n2": ("T", "S", None, None, None, None), "mixed": ("T", "S", None, None, None, None)}
    assert {(r.date, r.source_location, r.source_editorial, r.gai_promptversion, r.collection_name) for r in ok.collect()} == {(dt.date(2024, 2, 3), "here", "None Specified", "3", "c")}
    no_pass = "missing auto.gai analysis block"
    assert sorted((str(b.doc_id), b.reason) for b in bad.collect()) == sorted([("x", "duplicate doc_id within file"), ("n1", "duplicate doc_id within file"), ("None", "not an object"), ("None", "not an object"), ("None", "not an object"), ("z", no_pass), ("None", no_pass), ("d", "unreadable date"), ("s", "missing source.name.transliterated"), ("t", "label without a type"), ("c", "missing custom.atom.collection_name")])
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.jsonl").write_text("\n".join(json.dumps(r) for r in (twice, record("x", []), record("y", []))) + "\n\nnot json\n")
    ok, bad = label_records.read_label_json(spark, str(lines), lines=True)
    assert {r.doc_id: r.category for r in ok.collect()} == {"x": "Social", "y": None}
    assert sorted(b.reason for b in bad.collect()) == ["duplicate doc_id within file", "not an object"]


def test_finance_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Project ID,Title,Commitment Year,Amount,Recommended For Aggregates,Start Date\n7,Dam,2019.0,1.5,Yes,4/5/2019\n8,,x,,No,\n")
    (tmp_path / "l.csv").write_text("Project ID,ADM1,ADM2\n7,A,B\n9,C,D\n")
    p = readers.read_finance_projects(spark, str(tmp_path / "p.csv"))
    assert [(r.project_id, r.commitment_year, r.amount, r.recommended, r.start_date) for r in p.orderBy("project_id").collect()] == [("7", 2019, 1.5, True, dt.date(2019, 4, 5)), ("8", None, None, False, None)]
    assert [r.project_id for r in readers.read_finance_locations(spark, str(tmp_path / "l.csv"), p).collect()] == ["7"]


def test_embeddings_and_exports(spark, tmp_path):
    spark.createDataFrame([('{"doc_id": "a"}', "[1.0, 2.0]"), ('{"doc_id": "b"}', "[3.0, 4.0]")], "metadata string, embedding string").write.parquet(str(tmp_path / "e"))
    got = readers.read_embeddings_parquet(spark, str(tmp_path / "e"), spark.createDataFrame([("a",)], "doc_id string")).collect()
    assert [(r.doc_id, list(r.embedding)) for r in got] == [("b", [3.0, 4.0])]
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "country string, n int")
    writers.write_partitioned_export(df, str(tmp_path / "out"), ["country"])
    assert spark.read.parquet(str(tmp_path / "out/data")).count() == 3
    assert {r.country: r.rows for r in spark.read.json(str(tmp_path / "out/manifest")).collect()} == {"x": 2, "y": 1}
    writers.write_chart_csv(df, str(tmp_path / "csv"), ["n"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    relevant = spark.createDataFrame([("q", 2), ("q", 3), ("p", 1)], "query_id string, doc_id long")
    got = {r.query_id: (r.recall, r.hit, r.rr) for r in quality.ranking_metrics(ranked, relevant, "doc_id", 2).collect()}
    assert got == {"q": (0.5, True, 0.5), "p": (0.0, False, 0.0)}


def test_split_by_drift():
    x, y = [1.0, 0.0], [0.0, 1.0]
    # no drift before a block has three rows; then the turn begins a block, and gap and drift are seen before short blocks are merged
    assert series.split_blocks(days(*range(8)), [x, y, x, x, y, y, y, x], 0.5) == [0, 0, 0, 0, 1, 1, 1, 1]
    assert series.split_blocks(days(0, 1, 2, 3, 4, 60, 61, 62), [x, x, x, y, y, y, y, y], 0.5) == [0, 0, 0, 0, 0, 1, 1, 1]
    assert series.split_blocks(days(0, 1, 2, 3, 4, 5), [x, x, x, y, y, y], None) == [0] * 6


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]] if (last := row) else row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


SOME = ["Trade Summit 2024", "Trade Summit 2025", "trade sumit 2024", "Port deal", "Port deals", "Airport dealing", "an", "panda", "a", "aa", "aaa", "aaaa", "aaaab", "Energy", "Energie", "Energi", "b", "", "Port deal signed in May", "Ümlaut", "Umlaut"]


@pytest.mark.parametrize("above", [0.5, 0.78, 0.85])
def test_fuzzy_names_are_kept_greedily(spark, above):
    import random

    rng = random.Random(5)
    pool = SOME + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    pool = sorted(set(pool))
    rank = {n: i * 7919 % 1009 for i, n in enumerate(pool)}
    like = lambda a, b: 1 - edit_distance(a.lower(), b.lower()) / max(len(a), len(b), 1)
    kept = []
    for n in sorted(pool, key=lambda n: (rank[n], n)):
        if not any(like(n, k) > above for k in kept):
            kept.append(n)
    df = spark.createDataFrame([(n, rank[n]) for n in pool], "name string, rank long").repartition(4)
    assert sorted(r.name for r in names.dedupe_fuzzy_names(df, above).collect()) == sorted(kept)


def test_similar_names_by_brute_force(spark):
    def grams(n):
        import re

        ws = [w for w in re.split(r"[^\w]+|_", n.lower()) if w]
        return {("  " + w + " ")[i : i + 3] for w in ws for i in range(len(w) + 1)}

    want = set()
    for a in SOME:
        for b in SOME:
            x, y = grams(a), grams(b)
            if a < b and a and (a in b or b in a or (x | y and len(x & y) / len(x | y) > 0.6)):
                want.add((a, b))
    got = {(r.a, r.b) for r in names.similar_name_pairs(spark.createDataFrame([(n,) for n in SOME if n], "name string")).collect()}
    assert got == want and ("an", "panda") in got


@pytest.mark.parametrize("size", [3, 1024])
def test_tiles_give_all_pairs(spark, size):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(40, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)] + [(99, None, 0), (98, [0.0] * 4, 0)], "vec_id long, embedding array<double>, k int")
    got = {(r.a, r.b) for r in tiles.similar_pairs(df, ["k"], 0.4, size).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 and round(float(u[i] @ u[j]), 6) >= 0.4}
    q = df.where("vec_id < 5").selectExpr("vec_id AS query_id", "embedding AS q")
    near = tiles.nearest(q, df, 3, size).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, 3).alias("n"))
    for r in near.collect():
        order = sorted(range(40), key=lambda i: (-round(float(u[r.query_id] @ u[i]), 6), i))[:3]
        assert [x.vec_id for x in r.n] == order


def test_campaigns_need_recipients(spark):
    rows = [(1, 12, 0.6, 4, {"a": 5, "b": 7}), (2, 12, 0.6, 3, {"a": 5}), (3, 9, 0.9, 9, {"a": 5}), (4, 12, 0.4, 9, {"a": 5}), (5, 20, 0.7, 5, {"c": 2, "a": 2})]
    df = spark.createDataFrame(rows, "theme int, n long, coherence double, n_recipients long, actors map<string,long>")
    assert [(r.theme, r.dominant) for r in construct.coherent_campaigns(df).collect()] == [(5, "a"), (1, "b")]


def test_binseg_in_sql(spark):
    series.binseg_udtf(spark)
    y = [10.0 + (i % 2) for i in range(12)] + [40.0 + (i % 2) for i in range(11)]
    df = spark.createDataFrame([("a", [dt.date(2023 + i // 12, 1 + i % 12, 1) for i in range(23)][::-1], y[::-1])], "k string, m array<date>, y array<double>")
    (r,) = spark.sql("SELECT k, c.* FROM {d} d, LATERAL binseg(d.m, d.y) c", d=df).collect()
    assert r.cp_month == dt.date(2024, 1, 1) and r.post_mean > 40


def test_cooldown_as_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    for part in ((0, 10, 59, 61), (100, 121, 130, 181)):
        spark.createDataFrame([(k, t + dt.timedelta(minutes=m)) for k in (1, 2) for m in part], "rule_id long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = jobs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = sorted((r.rule_id, (r.at - t).total_seconds() / 60) for r in jobs.drain(jobs.cooled(s, 60), "append").collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [(k, m) for k in (1, 2) for m in (0, 61, 121, 181)]


def test_ordered_union_of_recipients_and_categories(spark, tmp_path):
    rng = random.Random(6)
    names = ["Q", "B", "LARGE", "A", "Z", "SMALL"]  # a country may be called like a category
    orders = [3 * i for i in range(80)]
    lines = [(o, rng.randrange(6), rng.randrange(8)) for o in orders for _ in range(rng.randint(0, 5))]
    kinds = ["SMALL", "PROMO", "LARGE", "ECONOMY", "PROMO", "B", "SMALL", "X"]
    events = [(i, dt.datetime(2024, 1, 1 + i % 9), rng.randrange(7), "click", 1.0) for i in range(60)]
    for name, rows, schema in (
        ("nation", [*enumerate(names)], "n_nationkey long, n_name string"),
        ("supplier", [(i, i) for i in range(6)], "s_suppkey long, s_nationkey long"),
        ("part", [*enumerate(kinds)], "p_partkey long, p_type string"),
        ("orders", [(o,) for o in orders], "o_orderkey long"),
        ("lineitem", lines, "l_orderkey long, l_suppkey long, l_partkey long"),
        ("events", events, "event_id long, ts timestamp, user_id long, event_type string, value double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/sf/{name}.parquet")
    got = {r.id: (r.n, r["keys"]) for r in registry.QUERIES["union_arrays_ordered"](spark, f"file://{tmp_path}/sf").collect()}
    want, kept = {}, 0
    for user in {e[2] for e in events}:
        docs = {orders[e[0] % 10] for e in events if e[2] == user}
        ranked = []
        for pairs in ({(o, names[s]) for o, s, _ in lines}, {(o, kinds[p]) for o, _, p in lines}):
            n = collections.Counter(k for o, k in pairs if o in docs)
            ranked += sorted(n, key=lambda k: (-n[k], k))
        both = [*dict.fromkeys(ranked)]
        kept += len(ranked) > len(both) and both != sorted(both)
        want[user] = (len(both), ",".join(both))
    assert got == want and kept
    # the SQL has no row for an event without any
    duck = pytest.importorskip("duckdb").connect()
    for t in ("nation", "supplier", "part", "orders", "lineitem", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/sf/{t}.parquet/*.parquet')")
    assert {i: (n, k) for i, n, k in duck.execute(registry.SQL["union_arrays_ordered"]).fetchall()} == {i: x for i, x in want.items() if x[0]}


def test_ordered_union_of_arrays(spark):
    rows = [(0, ["c", "a"], ["b", "a", "d"]), (1, None, ["b", "a"]), (2, ["z", "a", "z"], None), (3, [], []), (4, None, None)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = [r.u for r in df.select("i", C.union_arrays_ordered(F.col("a"), F.col("b")).alias("u")).orderBy("i").collect()]
    assert got == [["c", "a", "b", "d"], ["b", "a"], ["z", "a"], [], []]
