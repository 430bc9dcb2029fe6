"""Every registered query against its SQL in DuckDB, on the smallest tables; and that the queries without SQL run."""

import collections
import datetime
import decimal
import math
import os
import re

import pytest

import __spark_entry__ as entry
from newsgrain.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    return v if not isinstance(v, datetime.datetime) else v.replace(tzinfo=None)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.SQL:
        return
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    key = lambda r: repr([plain(r[c]) for c in sorted(columns)])
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_cooldown_sees_every_event(spark):
    last, want = {}, []
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts").orderBy("ts").collect():
        if r.user_id not in last or r.ts - last[r.user_id] >= datetime.timedelta(minutes=240):
            last[r.user_id] = r.ts
            want.append((r.user_id, r.ts))
    got = [(r.rule_id, r.at) for r in registry.QUERIES["alert_cooldown"](spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("name", ["narrative_themes", "theme_summary", "coherent_campaigns"])
def test_themes_grow_with_the_table(spark, monkeypatch, name):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA

    seen = {}
    for kind in (KMeans, PCA):
        monkeypatch.setattr(kind, "fit", lambda self, df, fit=kind.fit: seen.update({type(self): self.getK()}) or fit(self, df))
    registry.QUERIES[name](spark, "/root/testdata/sf0.1")
    assert seen == {KMeans: 2000 // 25, PCA: 50}


def words(text):
    return {w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w}


def test_keyword_search_asks_all_words(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(q, n) for q, w in asked.items() if w and (n := min(10, sum(w <= d for d in docs.values())))}
    rows = registry.QUERIES["keyword_search"](spark, SF).collect()
    assert all(asked[r.query_id] <= docs[r.doc_id] for r in rows)
    assert set(collections.Counter(r.query_id for r in rows).items()) == want


def test_hybrid_fuses_a_keyword_search(spark):
    run = lambda name: {(r.query_id, r.vec_id): r for r in registry.QUERIES[name](spark, SF).collect()}
    left, full = run("hybrid_search_text"), run("hybrid_search_text_full")
    assert set(left) < set(full)
    part = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for q, i in set(full) - set(left):
        assert words(part[q].p_type) <= words(part[i].p_name + " " + part[i].p_type)


def test_rerank_reads_texts(spark):
    from newsgrain.plans import queries_more
    from newsgrain.plans.model import Model

    part = {r.p_partkey: words(r.p_name + " " + r.p_type) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in queries_more.reranked(Model(spark, SF)).collect():
        a, b = part.get(r.query_id), part.get(r.vec_id)
        assert r.rerank_score == (pytest.approx(len(a & b) / len(a | b)) if a and b else None)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
