"""Derived facts kept in the shared folder, and made again only when what they come from has changed.

A fact is named by a print of its inputs' files (path, length and time of change), so it is found or it is not: nothing is ever overwritten, and two applications that make it at once make the same.
Facts of months are kept a month each under a print of the month's own rows. When files change, rows are read again, but only months whose rows differ are made; the others stay where they are.
Facts by a key are bucketed by it, so that joins on the key need no shuffle. They are not sorted: Spark does not rely on the order of bucketed files, and would sort them again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import _path, exists

BUCKET = 64 << 20


class FactStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        # Spark 4.1 takes a union of tables bucketed alike for one bucketed table, but reads it in twice as many parts: joins of it fail, and keys would not meet
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def files(self, inputs: Sequence[str]) -> tuple[str, int]:
        """Print of all files of some tables, and their bytes."""
        told, size = [], 0
        for where in inputs:
            path, fs = _path(self.spark, where)
            for f in sorted(fs.listStatus(path), key=lambda f: f.getPath().toString()):
                told.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
                size += f.getLen()
        return hashlib.md5("\n".join(told).encode()).hexdigest()[:16], size

    def _publish(self, made: str, where: str) -> None:
        """Gives a finished folder its name. Where another has been quicker, that one stays."""
        (old, fs), (new, _) = _path(self.spark, made), _path(self.spark, where)
        fs.mkdirs(new.getParent())
        if fs.exists(new) or not fs.rename(old, new):
            fs.delete(old, True)

    def whole(self, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], by: str, distinct: bool = False) -> DataFrame:
        """A fact of all rows, or of the distinct ones, bucketed by `by`."""
        key, size = self.files(inputs)
        where, table = f"{self.path}/{name}-{key}", f"fact_{name}_{key}_{hashlib.md5(self.path.encode()).hexdigest()[:8]}".replace("-", "_")
        if not exists(self.spark, where):
            made, temporary = f"{where}-{uuid.uuid4().hex}", f"making_{uuid.uuid4().hex}"
            n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
            # rows of a bucket are brought together first, else each task writes a file for each bucket; equal rows are in one bucket, so they meet without another shuffle
            df = build().repartition(n, by)
            df = df.distinct() if distinct else df
            df.write.bucketBy(n, by).option("path", made).saveAsTable(temporary)
            self.spark.sql(f"DROP TABLE {temporary}")  # the files stay
            self._note(f"{made}/_fact_{n}", df.schema.json())
            self._publish(made, where)
        if not self.spark.catalog.tableExists(table):
            path, fs = _path(self.spark, where)
            note = next(f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("_fact_"))
            n = int(note.getName().removeprefix("_fact_"))
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _schema(self._read(note.toString())))
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet CLUSTERED BY ({by}) INTO {n} BUCKETS LOCATION '{where}'")
        return self.spark.table(table)

    def by_month(self, name: str, inputs: Sequence[str], source: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], month: str = "month") -> DataFrame:
        """A fact that each month of source gives by itself (build keeps the month)."""
        key, _ = self.files(inputs)
        note, folder = f"{self.path}/{name}/at-{key}", f"{self.path}/{name}"
        if not exists(self.spark, note):
            rows = source()
            h = F.xxhash64(*rows.columns)
            prints = rows.groupBy(month).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("s")).collect()  # a row a month
            parts = {r[month]: f"{r[month]}-{r.n}-{r.x & (1 << 64) - 1:x}-{r.s}" for r in prints}
            schema = build(rows.limit(0)).schema
            if new := {m: p for m, p in parts.items() if not exists(self.spark, f"{folder}/part={p}")}:
                self.make(rows, build, new, folder, month)
            self._note(note, "\n".join([schema.json(), *sorted(parts.values())]))
        told = self._read(note).split("\n")
        places = [f"{folder}/part={p}" for p in told[1:]]
        schema = _schema(told[0])
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def make(self, rows: DataFrame, build: Callable[[DataFrame], DataFrame], parts: dict, folder: str, month: str) -> None:
        """Writes the facts of some months, each under its part's name."""
        own = F.col(month)
        named = F.coalesce(*[F.when(own.eqNullSafe(F.lit(m)), F.lit(p)) for m, p in parts.items()])
        made = f"{folder}/making-{uuid.uuid4().hex}"
        build(rows.where(named.isNotNull())).withColumn("part", named).repartition("part").write.partitionBy("part").parquet(made)
        path, fs = _path(self.spark, made)
        for p in parts.values():
            if fs.exists(_path(self.spark, f"{made}/part={p}")[0]):
                self._publish(f"{made}/part={p}", f"{folder}/part={p}")
            else:  # the month gives no rows
                fs.mkdirs(_path(self.spark, f"{folder}/part={p}")[0])
        fs.delete(path, True)

    def _note(self, where: str, text: str) -> None:
        path, fs = _path(self.spark, where)
        fs.mkdirs(path.getParent())
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, where: str) -> str:
        path, fs = _path(self.spark, where)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))
