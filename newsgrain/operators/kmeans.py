"""k-means for many centres, over blocks of vectors, with distances as matrix products.

Spark's own fit clusters about four candidates a centre on the driver, alone, which grows with the square of the number of centres. Here seeds are drawn as k-means++ draws them, many at a time: vectors
are proposed by their squared distance to the centres so far, and one after the other kept with the probability that the centres kept before it in the round have left of that distance. Proposals of
a round are bounded, and what is missing is drawn in further rounds. Rounds of seeds and steps are jobs; the driver holds the centres and a round's proposals.

Draws depend on the seed and on a block's own bytes, so equal blocks give equal seeds wherever they are read. Where there are fewer different vectors than centres asked for, each is a centre. A centre
that no vector is nearest to stays where it is."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Vectors a block, proposals a round, centres a product.
ROWS, DRAWN, WIDE = 2048, 2048, 2048
#: Squared distances below this are taken for none.
NONE = 1e-18


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def blocks(vectors: DataFrame) -> DataFrame:
    """vectors: p (array<double>) -> v: the vectors of up to ROWS rows of a partition, one after the other, and n, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                held.append(matrix(b.column(0).slice(lo, ROWS)))
                rows += len(held[-1])
                while rows >= ROWS:
                    every = np.concatenate(held)
                    yield block(every[:ROWS])
                    held, rows = [every[ROWS:]], rows - ROWS
        if rows:
            yield block(np.concatenate(held))

    block = lambda v: pa.RecordBatch.from_pydict({"n": pa.array([len(v)], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})
    return vectors.select("p").mapInArrow(run, "n int, v binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for n, v in zip(b.column("n"), b.column("v"), strict=True):
            yield np.frombuffer(v.as_buffer(), np.float64).reshape(n.as_py(), -1)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centre (the first, if several are) and its squared distance."""
    best, at = np.full(len(v), np.inf), np.zeros(len(v), np.int32)
    for lo in range(0, len(centres), WIDE):
        c = centres[lo : lo + WIDE]
        d = v @ (-2 * c.T)
        d += (c * c).sum(axis=1)
        j = d.argmin(axis=1)
        x = d[np.arange(len(v)), j]
        closer = x < best
        best[closer], at[closer] = x[closer], j[closer] + lo
    return at, ((v - centres[at]) ** 2).sum(axis=1)


def proposals(vectors: DataFrame, centres: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most m vectors, drawn one after the other by their squared distance to the centres (without centres: alike), and those distances."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, gaps, kept = np.empty(0), np.empty(0), None
        for v in opened(batches):
            gap = nearest(v, shared.value)[1] if len(shared.value) else np.ones(len(v))
            some = np.flatnonzero(gap > NONE)
            # of exponential times with these rates, the order is that of draws without putting back
            rng = np.random.default_rng([seed, len(shared.value), zlib.crc32(v.tobytes())])
            key = rng.exponential(size=len(v))[some] / gap[some]
            keys, gaps, kept = np.append(keys, key), np.append(gaps, gap[some]), v[some] if kept is None else np.concatenate([kept, v[some]])
            if len(keys) > m:
                first = np.argpartition(keys, m)[:m]
                keys, gaps, kept = keys[first], gaps[first], kept[first]
        if len(keys):
            yield pa.RecordBatch.from_pydict({"key": keys, "gap": gaps, "v": pa.array([x.tobytes() for x in kept], pa.binary())})

    got = vectors.mapInArrow(run, "key double, gap double, v binary").orderBy("key", "v").limit(m).select("gap", "v").toArrow()
    shared.unpersist()
    return got.column("gap").to_numpy(), np.array([np.frombuffer(x.as_py(), np.float64) for x in got.column("v")])


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """k of the vectors, or all different ones if these are fewer."""
    rng = np.random.default_rng(seed)
    _, centres = proposals(vectors, np.empty(0), 1, seed)
    while 0 < len(centres) < k:
        gap, v = proposals(vectors, centres, min(DRAWN, 2 * (k - len(centres)) + 64), seed)
        if not len(v):
            break
        kept, left = [], gap.copy()
        for i, u in enumerate(rng.random(len(v))):
            if u * gap[i] < left[i] and left[i] > NONE:
                kept.append(i)
                left = np.minimum(left, ((v - v[i]) ** 2).sum(axis=1))
        centres = np.concatenate([centres, v[kept[: k - len(centres)]]])
    return centres


def stepped(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean of the vectors that are nearest to each centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def total(of: np.ndarray, n: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        return of[order][first], np.add.reduceat(n[order], first), np.add.reduceat(v[order], first, axis=0)

    def summed(of: np.ndarray, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        of, n, v = total(of, n, v)
        return pa.RecordBatch.from_pydict({"centre": pa.array(of, pa.int32()), "n": pa.array(n, pa.int64()), "v": pa.array([x.tobytes() for x in v], pa.binary())})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in opened(batches):
            yield summed(nearest(v, shared.value)[0], np.ones(len(v), np.int64), v)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                more = (b.column("centre").to_numpy(), b.column("n").to_numpy(), np.frombuffer(b"".join(b.column("v").to_pylist())).reshape(b.num_rows, -1))
                held = total(*(more if held is None else [np.concatenate(x) for x in zip(held, more, strict=True)]))
        if held:
            yield summed(*held)

    fields = "centre int, n long, v binary"
    got = vectors.mapInArrow(near, fields).repartition("centre").sortWithinPartitions("centre", "v").mapInArrow(means, fields).toArrow()  # a row a centre
    shared.unpersist()
    out = centres.copy()
    for i, n, v in zip(got.column("centre").to_pylist(), got.column("n").to_pylist(), got.column("v").to_pylist(), strict=True):
        out[i] = np.frombuffer(v) / n
    return out


def fit(vectors: DataFrame, k: int, seed: int, steps: int = 20, tol: float = 1e-4) -> np.ndarray:
    """vectors: blocks, saved. Centres after so many steps, or when none moves further than tol."""
    centres = seeds(vectors, k, seed)
    for _ in range(steps):
        old, centres = centres, stepped(vectors, centres)
        if not len(old) or ((centres - old) ** 2).sum(axis=1).max() <= tol * tol:
            break
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray, name: str) -> DataFrame:
    """vectors (with p, array<double>) and the number of the nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                yield part.append_column(name, pa.array(nearest(matrix(part.column("p")), shared.value)[0], pa.int32()))

    return vectors.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + f", {name} int")
