"""A persisted inverted index of vectors: trained cells, rings by angle to the cell's centre, and several probes.

Cells are trained on a bounded sample; every vector is then filed under its nearest centre. In a cell, vectors are ordered by their angle to the centre and cut into rings of about a tile. How many
cells a query has to probe is learnt when the index is built: a sample of vectors is searched exactly, and the numbers of nearest cells that hold the wanted share of what was found, at several depths,
are kept with the index. So vectors without structure get many probes, and clustered ones few. The k nearest among a share of all rows, which a filter lets through, are about the k / share nearest of all,
so they are probed for at that depth.

A search first asks each query's nearest cell. Then, of the other cells to be probed, only those rings are read that can hold something better than the k-th found so far: by the triangle inequality on
angles a vector of a ring is no nearer to the query than the ring is to the query's own angle. Filters are applied to the rows before anything is ranked. A query that has less than k rows after its
probes goes on to further cells, twice as many each time, until it has k or has seen all."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import written
from .tiles import TILE, angles, best_of_tile, nearest, ringed, unit

CELLS, SAMPLE, ASKED = 4096, 65_536, 256
#: How many nearest vectors the numbers of probes are learnt for.
DEPTHS = (10, 40, 160, 640)


def trained(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres (unit vectors) by spherical k-means, started from evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
    return centres


class VectorIndex:
    """Folder of an index: rows (by cell), rings, and centres with the number of probes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.probes, fields = dict(zip(about.depths, about.probes, strict=True)), StructType.fromJson(json.loads(about.fields))
        held = spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres").orderBy("cell").toArrow()  # at most CELLS rows
        self.centres = unit(held.column("centre"))
        self.rows = spark.read.schema(fields).parquet(f"{self.path}/rows")
        self.rings = spark.read.schema("cell int, ring int, low double, high double, n long").parquet(f"{self.path}/rings")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, asked: int = ASKED, recall: float = 0.95, size: int = TILE) -> VectorIndex:
        """Index of vectors (vec_id, embedding; other columns are kept, for filters). cells: by default a cell for the square root of the number of rows, at most CELLS. sample: rows to train on; asked:
        rows searched exactly to learn how many probes find `recall` of their nearest. Null vectors are left out."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        v = vectors.where("embedding IS NOT NULL")
        n = v.count()
        cells = max(1, min(cells or round(n**0.5), CELLS, sample))
        few = v.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).toArrow()  # `sample` rows
        centres = trained(unit(few.column("embedding")), min(cells, few.num_rows)) if few.num_rows else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

        def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    far = angles(unit(pa.chunked_array([b.column("embedding")])), shared.value)
                    near = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], names=[*b.schema.names, "cell", "angle"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in v.schema)
        rows, _ = written(v.mapInArrow(filed, f"{fields}, cell int, angle double"), "filed")
        dealt = ringed(rows, ["cell"], size)
        dealt = dealt.select(*v.columns, "ring", "angle", "cell")
        dealt.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{path}/rows")
        kept = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
        kept.groupBy("cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).write.parquet(f"{path}/rings")
        probes = [1] * len(DEPTHS)
        if len(centres):
            some = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).orderBy(F.xxhash64("query_id"), "query_id").limit(asked)
            near = nearest(some, v.select("vec_id", "embedding"), DEPTHS[-1] + 1, size).where("vec_id <> query_id")
            near = near.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= DEPTHS[-1])
            places = cls._places(some, shared, 0, len(centres)).select(F.col("query_id").alias("_q"), F.col("cell").alias("_c"), "place")
            found = near.join(kept.select("vec_id", "cell"), "vec_id").join(places, (F.col("query_id") == F.col("_q")) & (F.col("cell") == F.col("_c")))
            held = found.agg(*[F.percentile(F.when(F.col("r") <= d, F.col("place")), recall).alias(f"d{d}") for d in DEPTHS]).first()
            probes = [math.ceil(x or 0) + 1 for x in held]
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        spark.createDataFrame([(list(DEPTHS), probes, dealt.schema.json())], "depths array<int>, probes array<int>, fields string").coalesce(1).write.parquet(f"{path}/about")
        return cls(spark, path)

    @staticmethod
    def _places(queries: DataFrame, shared, start: int, stop: int) -> DataFrame:
        """query_id, q, cell, place, angle: the cells in places start to stop - 1 by angle to each query."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    far = angles(unit(pa.chunked_array([part.column("q")])), shared.value)
                    order = np.argsort(far, axis=1, kind="stable")[:, start:stop]
                    row = np.repeat(np.arange(part.num_rows), order.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), part.column("q").take(pa.array(row)), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(start, start + order.shape[1]), part.num_rows).astype(np.int32)), pa.array(far[row, order.ravel()])], names=["query_id", "q", "cell", "place", "angle"])

        kind, vector = (queries.schema[c].dataType.simpleString() for c in ("query_id", "q"))
        return queries.select("query_id", "q").where("q IS NOT NULL").mapInArrow(run, f"query_id {kind}, q {vector}, cell int, place int, angle double")

    def pairs(self, queries: DataFrame, start: int, stop: int, least: DataFrame | None) -> DataFrame:
        """query_id, q, cell, ring: what is to be compared. least: query_id and the score that has to be reached."""
        asked = self._places(queries, self.spark.sparkContext.broadcast(self.centres), start, stop).join(self.rings, "cell")
        if least is None:
            return asked
        gap = F.greatest(F.lit(0.0), F.col("low") - F.col("angle"), F.col("angle") - F.col("high"))
        return asked.join(least, "query_id", "left").where(F.col("least").isNull() | (F.cos(gap) >= F.col("least") - 1e-6))

    def compared(self, pairs: DataFrame, k: int, filters: Column | str | None) -> DataFrame:
        """query_id, vec_id, score of the k best of each ring for each query that asks it."""
        rows = self.rows if filters is None else self.rows.where(filters)
        # a ring that very many queries ask is compared in blocks of queries
        pairs, _ = written(pairs.select("query_id", "q", "cell", "ring").withColumn("block", F.floor((F.row_number().over(W.partitionBy("cell", "ring").orderBy("query_id")) - 1) / TILE)), "compared")
        read = rows.join(pairs.select("cell", "ring", "block").distinct().toDF("cell", "ring", "block"), ["cell", "ring"]).select("cell", "ring", "block", "vec_id", "embedding")
        key = ["cell", "ring", "block"]
        kinds = pairs.schema["query_id"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
        return pairs.select(*key, "query_id", "q").groupBy(*key).cogroup(read.groupBy(*key)).applyInArrow(best_of_tile(k), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")

    def needed(self, k: int, filters: Column | str | None = None) -> int:
        """Probes for the k nearest of the rows that pass the filters."""
        depth = k
        if filters is not None:
            passed, n = self.rows.agg(F.count(F.when(F.expr(filters) if isinstance(filters, str) else filters, 1)), F.count("*")).first()
            depth = k * n / max(passed, 1)
        return next((p for d, p in sorted(self.probes.items()) if d >= depth), len(self.centres))

    def search(self, queries: DataFrame, k: int, filters: Column | str | None = None, probes: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank of the k best that the probed cells have for each query (query_id, q)."""
        cells = len(self.centres)
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        kinds = queries.schema["query_id"].dataType.simpleString(), self.rows.schema["vec_id"].dataType.simpleString()
        if not cells:
            return self.spark.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, score double, rank int")
        found, _ = written(best(self.compared(self.pairs(queries, 0, 1, None), k, filters)), "found")
        start, stop = 1, max(1, min(probes or self.needed(k, filters), cells))
        while True:
            if stop > start:
                least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
                more = self.compared(self.pairs(queries, start, stop, least), k, filters)
                found, _ = written(best(found.drop("rank").unionByName(more)), "found")
            queries = queries.join(found.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
            if stop >= cells or queries.isEmpty():
                return found
            start, stop = stop, min(2 * stop, cells)
