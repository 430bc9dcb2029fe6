"""Structured Streaming jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import columns as C
from ..operators.quality import new_rows
from ..operators.store import children, exists, forget, new_dir


def file_stream(spark: SparkSession, path: str, schema: StructType, most_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


class LedgerSink:
    """Rows in parts, and a ledger of the parts that are complete. A part is written first and entered in the ledger afterwards, so what a lost attempt has left is never read and goes with the next
    append. Keys that are there already are refused, whenever and under whatever batch they come; a batch that comes again therefore adds nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def ledger(self) -> DataFrame:
        entry = "stream string, batch long, part string, n long"
        return self.spark.read.schema(entry).parquet(f"{self.path}/ledger") if exists(self.spark, f"{self.path}/ledger") else self.spark.createDataFrame([], entry)

    def read(self) -> DataFrame:
        parts = [f"{self.path}/rows/{r.part}" for r in self.ledger().where("n > 0").select("part").collect()]  # one a batch
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, keys: Sequence[str], stream: str, batch: int, shaped: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Appends shaped(rows of new keys). shaped must keep the keys."""
        known = {r.part for r in self.ledger().select("part").collect()}
        forget(self.spark, *[f"{self.path}/rows/{part}" for part in children(self.spark, f"{self.path}/rows") if part not in known])
        part = f"part-{uuid.uuid4().hex}"
        shaped(new_rows(rows, self.read(), keys)).write.parquet(f"{self.path}/rows/{part}")
        self._enter(stream, batch, part, self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{part}").count())

    def _enter(self, stream: str, batch: int, part: str, n: int) -> None:
        self.spark.createDataFrame([(stream, batch, part, n)], "stream string, batch long, part string, n long").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")


def stream_ingest_files(spark: SparkSession, path: str, schema: StructType, sink: LedgerSink, checkpoint: str, key: str = "doc_id"):
    """New files only, each document once whatever its time, appended as flattened labels (doc_id, label). Of rows that repeat a document in a batch the smallest stays."""
    flat = lambda df: df.select(key, F.explode(F.array_distinct(C.split_multi(F.col("labels")))).alias("label"))
    w = file_stream(spark, path, schema).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.foreachBatch(lambda rows, n: sink.append(rows, [key], checkpoint, n, flat)).start()


def windowed_counts(events: DataFrame, ts: str, keys: Sequence[str], size: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts. In append mode a window is told once, when the watermark has passed its end, and rows of windows that ended before the watermark are dropped; in update mode each
    change is told, under the same rule. In complete mode all windows are held and told, and nothing is dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("date").alias("day"), *keys, "n")


def event_sessions(mentions: DataFrame, ts: str, keys: Sequence[str], gap: str = "30 days", delay: str = "1 day") -> DataFrame:
    g = mentions.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def cooled(firings: DataFrame, minutes: int):
    """The stateful form of alert_cooldown: firings (rule_id, at) of a stream that come no sooner than `minutes` after the last one let through of their rule. State is one time a rule; each batch is
    taken in order of time."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    least = pd.Timedelta(minutes=minutes)

    class Cooldown(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "at timestamp")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            held = self.last.get()
            last = pd.Timestamp(held[0]) if held is not None else None
            at = pd.concat(rows)["at"].dropna().sort_values()
            keep = []
            for t in at:
                if last is None or t - last >= least:
                    keep.append(t)
                    last = t
            if keep:
                self.last.update((last.to_pydatetime(),))
            yield pd.DataFrame({"rule_id": [key[0]] * len(keep), "at": keep})

        def close(self) -> None:
            pass

    return firings.select("rule_id", "at").groupBy("rule_id").transformWithStateInPandas(statefulProcessor=Cooldown(), outputStructType=f"rule_id {firings.schema['rule_id'].dataType.simpleString()}, at timestamp", outputMode="Append", timeMode="None")


def seen_names(rows: DataFrame, minutes: int | None = None) -> DataFrame:
    """The stateful form of alert_new: the first row (name, at) of each name. State is a mark a name; with minutes, it lives as long and the name is new again afterwards (by the clock of the cluster)."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    live = None if minutes is None else minutes * 60_000

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.mark = handle.getValueState("mark", "seen boolean", live) if live else handle.getValueState("mark", "seen boolean")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            first = pd.concat(rows)["at"].min()
            if not self.mark.exists():
                self.mark.update((True,))
                yield pd.DataFrame({"name": [key[0]], "at": [first]})

        def close(self) -> None:
            pass

    out = f"name {rows.schema['name'].dataType.simpleString()}, at timestamp"
    return rows.select("name", "at").groupBy("name").transformWithStateInPandas(statefulProcessor=Seen(), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if live else "None")


def surges(events: DataFrame, key: str, ts: str, value: str | None = None, days: int = 30, z: float = 2.0, delay: str = "1 day") -> DataFrame:
    """The stateful form of alert_surge, day by day: key, day, latest, mean, z. A day's number is how many rows it has, or the mean of value. A day is judged once, by a timer, when the watermark has
    passed its end: against the days before it in the window, if there are five days in all and they differ. State is the days of the window; a late row counts until its day is judged."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    length = 86_400_000
    kind = events.schema[key].dataType.simpleString()

    class Surges(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getMapState("days", "ends long", "total double, n long")  # by the end of the day

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            for ends, part in pd.concat(rows).groupby("ends")["x"]:
                before = self.held.getValue((int(ends),)) if self.held.containsKey((int(ends),)) else (0.0, 0)
                self.held.updateValue((int(ends),), (before[0] + float(part.sum()), before[1] + len(part)))
                self.handle.registerTimer(int(ends))
            return iter(())

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs()
            latest, past, old = None, [], []
            for (ends,), (total, n) in self.held.iterator():
                back = round((now - ends) / length)
                x = total / n if value else float(n)
                if back >= days:
                    old.append(ends)
                elif back == 0:
                    latest = x
                elif back > 0:
                    past.append(x)
            for ends in old:
                self.held.removeKey((ends,))
            if latest is not None and len(past) >= 4:
                past = pd.Series(sorted(past))
                mean, std = past.mean(), past.std(ddof=0)
                if std > 0 and round((latest - mean) / std, 6) >= z:
                    day = (pd.Timestamp(now - length // 2, unit="ms")).date()
                    yield pd.DataFrame({"key": [key[0]], "day": [day], "latest": [latest], "mean": [round(mean, 6)], "z": [round((latest - mean) / std, 6)]})

        def close(self) -> None:
            pass

    ends = F.unix_millis(F.date_add(F.to_date(ts), 1).cast("timestamp"))
    x = F.col(value).cast("double") if value else F.lit(1.0)
    rows = events.withWatermark(ts, delay).where(x.isNotNull()).select(F.col(key).alias("key"), ts, ends.alias("ends"), x.alias("x"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Surges(), outputStructType=f"key {kind}, day date, latest double, mean double, z double", outputMode="Append", timeMode="EventTime")


def fed(spark: SparkSession, steps: Sequence[DataFrame], query: Callable[[DataFrame], DataFrame], mode: str) -> tuple[DataFrame, int]:
    """What a stream says when its files come in steps and it is started anew from its checkpoint after each, with column `said` (the number of the batch); and how many rows its operators report as
    dropped for being late (after their first, partial aggregation)."""
    source, sink, checkpoint = (new_dir(spark, x) for x in ("steps", "stream", "stream-checkpoint"))
    dropped, schema = 0, None
    for rows in steps:
        rows.write.mode("append").parquet(source)
        df = query(spark.readStream.schema(rows.schema).parquet(source))
        schema = df.schema
        w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        run = w.foreachBatch(lambda batch, n: batch.withColumn("said", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/batch={n}")).start()
        run.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in json.loads(p.json)["stateOperators"])
    return spark.read.schema(StructType([*schema, StructField("said", IntegerType())])).parquet(sink).select(*schema.names, "said"), dropped


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is and give what it says, from Parquet in the shared folder. In complete mode every batch replaces the one before."""
    spark = df.sparkSession
    sink, checkpoint = new_dir(spark, "stream"), new_dir(spark, "stream-checkpoint")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    # a batch that is tried again overwrites its own files
    w = w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(sink if mode == "complete" else f"{sink}/batch={n}"))
    w.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(sink).select(*df.columns)
