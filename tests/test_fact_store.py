"""Facts that are kept: read again where nothing has changed, and made again only where something has."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import facts
from newsgrain.operators.fact_store import FactStore
from newsgrain.plans import queries_counts
from newsgrain.plans.model import Model

SF = "/root/testdata/sf0.001"


def rows(spark, path, *months):
    data = [(dt.date(2024, m, 1), k, n) for m, ks in months for k, n in ks]
    spark.createDataFrame(data, "month date, k string, n long").coalesce(1).write.mode("overwrite").parquet(path)


def test_only_changed_months_are_made(spark, tmp_path):
    src, store = str(tmp_path / "src"), FactStore(spark, str(tmp_path / "facts"))
    made = []

    def fact():
        def build(df):
            if df.schema["n"].dataType.simpleString() == "bigint" and df.take(1):
                made.append(sorted({r.month.month for r in df.select("month").distinct().collect()}))
            return df.groupBy("month", "k").agg(F.sum("n").alias("n"))

        out = store.by_month("sums", [src], lambda: spark.read.parquet(src), build)
        return sorted((r.month.month, r.k, r.n) for r in out.collect())

    rows(spark, src, (1, [("a", 1), ("a", 2)]), (2, [("b", 5)]), (3, [("c", 7), ("c", 7)]))
    first = [(1, "a", 3), (2, "b", 5), (3, "c", 14)]
    assert fact() == first and fact() == first and made == [[1, 2, 3]]
    # a month changed, one gone, one new, one only in another order
    rows(spark, src, (1, [("a", 2), ("a", 1)]), (2, [("b", 6)]), (4, [("d", 1)]))
    assert fact() == [(1, "a", 3), (2, "b", 6), (4, "d", 1)] and made[1:] == [[2, 4]]
    # back to what was: nothing is made
    rows(spark, src, (1, [("a", 1), ("a", 2)]), (2, [("b", 5)]), (3, [("c", 7), ("c", 7)]))
    assert fact() == first and len(made) == 2
    # a repeated row is a change
    rows(spark, src, (3, [("c", 7), ("c", 7), ("c", 7), ("c", 7)]))
    assert fact() == [(3, "c", 28)] and made[2:] == [[3]]
    rows(spark, src)
    assert fact() == []


def test_whole_facts(spark, tmp_path):
    src, store = str(tmp_path / "src"), FactStore(spark, str(tmp_path / "facts"))
    made = []

    def fact(name="f"):
        return store.whole(name, [src], lambda: made.append(1) or spark.read.parquet(src).select("k", "n"), "k")

    rows(spark, src, (1, [(f"k{i}", i) for i in range(50)]))
    assert fact().count() == 50 and fact().count() == 50 and len(made) == 1
    again = FactStore(spark, store.path).whole("f", [src], lambda: pytest.fail("made again"), "k")
    assert {tuple(r) for r in again.collect()} == {(f"k{i}", i) for i in range(50)}
    rows(spark, src, (1, [("k", 1)]))
    assert [tuple(r) for r in fact().collect()] == [("k", 1)] and len(made) == 2
    assert not [x for x in os.listdir(tmp_path / "facts") if x.count("-") > 1]  # nothing half made is left


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_of_a_family_read_the_facts(spark, tmp_path):
    copy = str(tmp_path / "sf")
    shutil.copytree(SF, copy)
    os.chmod(copy, 0o755)
    m = Model(spark, copy)
    first = sorted(map(tuple, queries_counts.intensity(m).collect()), key=repr)
    assert first == sorted(map(tuple, facts.provenance_intensity(facts.report_base(m._d(), m._ic(), m._rc(), m._cat(), m.scope)).collect()), key=repr)
    later = Model(spark, copy)
    read = facts.actor_tensor(queries_counts.intensity(later)).inputFiles()
    assert read and all("/provenance-intensity/part=" in f for f in read)
    # bridges meet on doc_id without a shuffle
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = later.rc.join(later.cat, "doc_id").join(later.ic, "doc_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # another time of change makes other facts
    os.utime(f"{copy}/lineitem.parquet", (1, 1))
    assert Model(spark, copy).facts.files(m.inputs("lineitem")) != m.facts.files(m.inputs("orders", "lineitem"))
