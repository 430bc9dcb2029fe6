"""Streams that are killed, started again, sent rows again and sent rows late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import series
from newsgrain.plans.queries_more import rocks
from newsgrain.streaming import jobs

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "doc_id string, labels string, ts timestamp"


def send(spark, path, *rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def places(spark, tmp_path):
    sink = jobs.LedgerSink(spark, str(tmp_path / "sink"), "doc_id string, label string")
    return str(tmp_path / "in"), sink, str(tmp_path / "checkpoint"), spark.createDataFrame([], SCHEMA).schema


def labels(sink):
    return sorted((r.doc_id, r.label) for r in sink.read().collect())


def test_ingest_takes_each_document_once(spark, places):
    src, sink, ck, schema = places
    send(spark, src, ("1", "a; b", DAY), ("1", "a; b", DAY))
    send(spark, src, ("2", "c", DAY), ("3", None, DAY))
    for _ in range(2):  # a second run finds nothing new
        jobs.stream_ingest_files(spark, src, schema, sink, ck).awaitTermination()
    assert labels(sink) == [("1", "a"), ("1", "b"), ("2", "c")]
    # sent again a month later, with other labels, beside a new one; and from a new checkpoint
    send(spark, src, ("1", "z", DAY + dt.timedelta(31)), ("4", "d; d", DAY))
    jobs.stream_ingest_files(spark, src, schema, sink, ck).awaitTermination()
    jobs.stream_ingest_files(spark, src, schema, sink, ck + "-new").awaitTermination()
    assert labels(sink) == [("1", "a"), ("1", "b"), ("2", "c"), ("4", "d")]
    assert sink.ledger().groupBy("stream", "batch").count().where("count > 1").count() == 0


def test_killed_between_sink_and_checkpoint(spark, places):
    src, sink, ck, schema = places
    send(spark, src, ("1", "a; b", DAY))

    class Dies(jobs.LedgerSink):
        def append(self, *args):
            super().append(*args)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        jobs.stream_ingest_files(spark, src, schema, Dies(spark, sink.path, sink.schema), ck).awaitTermination()
    assert labels(sink) == [("1", "a"), ("1", "b")]
    jobs.stream_ingest_files(spark, src, schema, sink, ck).awaitTermination()  # the batch comes again
    assert labels(sink) == [("1", "a"), ("1", "b")] and [r.batch for r in sink.ledger().orderBy("n").collect()] == [0, 0]


def test_killed_between_rows_and_ledger(spark, places):
    src, sink, ck, schema = places
    send(spark, src, ("1", "a; b", DAY))

    class Dies(jobs.LedgerSink):
        def _enter(self, *args):
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        jobs.stream_ingest_files(spark, src, schema, Dies(spark, sink.path, sink.schema), ck).awaitTermination()
    assert labels(sink) == [] and len(jobs.children(spark, f"{sink.path}/rows")) == 1
    jobs.stream_ingest_files(spark, src, schema, sink, ck).awaitTermination()
    assert labels(sink) == [("1", "a"), ("1", "b")] and len(jobs.children(spark, f"{sink.path}/rows")) == 1


def at(day, hour=12):
    return DAY + dt.timedelta(days=day, hours=hour)


def test_late_rows_of_windows(spark):
    rows = [[("a", at(0)), ("a", at(0)), ("a", at(4))], [("a", at(0)), ("a", at(3)), ("b", at(5))], [("a", at(20)), ("b", at(2))]]
    frames = [spark.createDataFrame(r, "k string, ts timestamp") for r in rows]
    count = lambda e: jobs.windowed_counts(e, "ts", ["k"], delay="2 days")
    told, dropped = jobs.fed(spark, frames, count, "append")
    # after the first step the watermark is day 2, noon: the row of day 0 is late; after the second day 3, noon: so is that of day 2
    day = lambda n: (DAY + dt.timedelta(n)).date()
    assert sorted(map(tuple, told.select("k", "day", "n").collect())) == [("a", day(0), 2), ("a", day(3), 1), ("a", day(4), 1), ("b", day(5), 1)]
    assert dropped == 2
    told, _ = jobs.fed(spark, frames, count, "update")
    last = {}
    for r in told.orderBy("said").collect():
        last[r.k, r.day] = r.n
    assert last == {("a", day(0)): 2, ("a", day(3)): 1, ("a", day(4)): 1, ("b", day(5)): 1, ("a", day(20)): 1}


@pytest.mark.parametrize("value", [None, "v"])
def test_surges_equal_the_batch_form(spark, value):
    counts = [3, 5, 4, 6, 5, 4, 20, 5, 3, 4, 30, 4, 5, 6, 1, 18, 5]
    rows = [("k", at(d, h % 24), float(h + d)) for d, n in enumerate(counts) for h in range(n)] + [("few", at(d), 1.0) for d in (1, 3)] + [("k", at(4), None)]
    steps = [[r for r in rows if lo <= (r[1] - DAY).days < hi] for lo, hi in ((0, 7), (7, 12), (12, 99))]
    steps[1].append(("k", at(5), 50.0))  # late, but within four days of the newest
    frames = [spark.createDataFrame(s, "k string, ts timestamp, v double") for s in steps]
    with rocks(spark):
        told, _ = jobs.fed(spark, frames, lambda e: jobs.surges(e, "k", "ts", value, days=8, z=1.5, delay="4 days"), "append")
        got = {(r.key, r.day): (r.latest, r.mean, r.z) for r in told.collect()}
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    daily = every.where("v IS NOT NULL" if value else "true").groupBy("k", F.to_date("ts").alias("day")).agg((F.avg("v") if value else F.count("*").cast("double")).alias("x"))
    want = {}
    for d in range(17):
        if at(d, 24) <= max(r[1] for s in steps for r in s) - dt.timedelta(days=4):
            for r in series.alert_surge(daily, "x", at(d).strftime("%Y-%m-%d"), days=8, z=1.5, keys=["k"]).collect():
                if daily.where((F.col("k") == r.k) & (F.col("day") == at(d).date())).count():
                    want[r.k, at(d).date()] = (r.latest, r.mean, r.z)
    assert got.keys() == want.keys() and len(want) >= 2
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_seen_names_survive_a_restart(spark):
    frames = [spark.createDataFrame(r, "name string, at timestamp") for r in ([("x", at(2)), ("x", at(1)), ("y", at(1))], [("x", at(9)), ("z", at(0))], [("y", at(3)), (None, at(4))])]
    with rocks(spark):
        told, _ = jobs.fed(spark, frames, jobs.seen_names, "append")
        assert sorted(((r.name or "", r.at) for r in told.collect())) == [("", at(4)), ("x", at(1)), ("y", at(1)), ("z", at(0))]
