"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into parts of that length and a rest. Parts are dealt out by hash to shards of about `per_shard` parts, each packed by itself: what is
lost at the edge of a shard is a part of one bin. In a shard, parts go by length, longest first, to the open bin with the least room that holds them. Where none does, a bin is opened, and the
permitted lengths are weighed against each other by what is still to come: for each length, the room behind the part is filled on trial from the lengths that are left, longest first, and the
length that costs least for each word so filled is opened. A sequence costs its length, a fixed overhead, and attention, which grows with the square of the length; so short sequences are cheap
where they can be filled, and long ones where the short cannot. At the end each bin is downsized to the smallest permitted length that holds its contents. Only lengths are shuffled, not texts.

Empty and null texts have length 0 and take no room: bin_id, bin_size and bin_start are null. Very long texts are parts like any other. Equal lengths go in order of doc_id and part; repeated
rows are packed each for itself, and are numbered before they are dealt out, so that many equal ones do not meet in a shard. A null doc_id is packed like any other. Columns of any other name are
not read. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, saved, table

SIZES = (512, 1024, 2048, 4096)
#: Words that a sequence costs beside its own, and the length at which attention costs as much as all else.
OVERHEAD, ATTENTION = 16, 49_152
PER_SHARD = 4096


def sequence_cost(size: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return size + overhead + size * size / attention


def best_fit(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order, each at least 1: bin and start of each, and the final size of each bin."""
    sizes = sorted(sizes)
    costs = {s: cost(s) for s in sizes}
    left: dict[int, int] = {}
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    coming = sum(1 << n for n in left)  # bit n: a part of length n is still to come
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with r words of room is open
    bins, starts, filled = [], [], []

    def fill(room: int) -> int:
        """Words of a room that the longest parts to come, taken in turn, would fill."""
        got, taken = 0, {}
        may = coming
        while room:
            may &= (1 << (room + 1)) - 1
            if not may:
                break
            n = may.bit_length() - 1
            k = min(room // n, left[n] - taken.get(n, 0))
            if k:
                got, room, taken[n] = got + k * n, room - k * n, taken.get(n, 0) + k
            may &= ~(1 << n)
        return got

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            coming &= ~(1 << n)
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((s for s in sizes if s >= n), key=lambda s: (costs[s] / (n + fill(s - n)), s))
            k = len(filled)
            filled.append(0)
        bins.append(k)
        starts.append(filled[k])
        filled[k] += n
        if room > n:
            by_room.setdefault(room - n, []).append(k)
            rooms |= 1 << (room - n)
    return bins, starts, [min(s for s in sizes if s >= f) for f in filled]


def _packed(sizes: tuple[int, ...], cost: Callable[[int], float]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("part", "ascending")])
        lengths = rows.column("length").to_pylist()
        n = len(lengths) - lengths.count(0)
        bins, starts, final = best_fit(lengths[:n], sizes, cost)
        none = [None] * (len(lengths) - n)
        shard = key[0].as_py() << 32
        return pa.table({
            **{c: rows.column(c) for c in ("doc_id", "part", "length")},
            "bin_id": pa.array([shard + b for b in bins] + none, pa.int64()),
            "bin_size": pa.array([final[b] for b in bins] + none, pa.int64()),
            "bin_start": pa.array(starts + none, pa.int64()),
        })

    return run


def pack(docs: DataFrame, length: Column, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, part, length, bin_id, bin_size, bin_start for each part of each row of docs (doc_id, text); length gives a row's words."""
    top = max(sizes)
    # lengths are written once, and the texts are read no more; rows that are alike get numbers, so that they spread like others
    alike = saved(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), length.cast("long").alias("n")).groupBy("doc_id", "h", "n").agg(F.count("*").alias("times")), "lengths")
    rows = alike.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("times"))))
    shards = max(1, -(-(alike.agg(F.coalesce(F.sum(F.col("times") * F.greatest(F.lit(1), F.ceil(F.col("n") / top))), F.lit(0))).first()[0]) // per_shard))
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / top)).cast("int"))))
    parts = parts.select("doc_id", "part", F.least(F.lit(top), F.col("n") - F.col("part") * top).cast("long").alias("length"), F.pmod(F.xxhash64("h", "place", "part"), F.lit(shards)).cast("int").alias("shard"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return parts.groupBy("shard").applyInArrow(_packed(tuple(sizes), cost), f"doc_id {kind}, part int, length long, bin_id long, bin_size long, bin_start long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir).select("doc_id", "text"), n_words(F.col("text")))
