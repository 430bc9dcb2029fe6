"""Whitening of embeddings by a bidiagonal qd solver.

The distinct integer vectors are the fit list. Tasks reduce its centred rows block by block to a triangle by QR; triangles are combined in a tree of bounded fan-in, so that no task and not the driver
holds more than a few of them. The last triangle, as wide as a vector, is brought to a bidiagonal matrix by Householder reflections; dqds finds its singular values to high relative accuracy, and a
twisted factorisation for each of them gives its direction, without ever forming the covariance. Directions of values that agree to about nine digits are made orthogonal among themselves.

Rows whose vector is null or holds a null or non-finite entry (an entry of 2**50 or more counts as one, for its integer need not fit 64 bits) are left out, and so are vectors of another length than
most have (of two lengths that are as frequent, the greater counts). Rows that repeat a vec_id, and null ids, are kept each for itself; equal vectors count once in the fit and get equal results. A
component without variance (fewer distinct vectors than dimensions, or one vector only) has whitened null and explained 0 (null if nothing varies), and stays out of identity_error, which is null
without any other. A deviation beyond 64 bits is null. Of equal eigenvalues the components are some orthogonal basis. Other columns, of any name, are not read. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import batch
from .common import dropped, saved, table

COMPONENTS = 16
FAN = 16
ROWS = 4096
_EPS = np.finfo(float).eps
_LARGE = 1 << 50


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, in exact integers (of Python where 64 bits may not do)."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, total)) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def deviations(d: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact; null beyond 64 bits."""
    if d.dtype == np.int64 and int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
        return pa.array((d * d).sum(axis=1))
    sums = [sum(int(v) ** 2 for v in row) for row in d]
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of r = U B V' by Householder reflections."""
    a, width = r.copy(), r.shape[1]
    v = np.eye(width)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        u = x.copy()
        u[0] += math.copysign(size, x[0])
        return u / np.linalg.norm(u)

    for k in range(width):
        if (u := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 2 < width and (u := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential step with a shift; None where a quotient turns negative, that is, where the shift exceeds the least value."""
    new_q, new_e, d = [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0 or (top := d + e[i]) <= 0:
            return None
        ratio = q[i + 1] / top
        new_q.append(top)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    return (new_q + [d], new_e) if d >= 0 else None


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an unreduced bidiagonal matrix, falling."""
    q, e, moved, found = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0, []
    while q:
        if not e or e[-1] <= _EPS**2 * (moved + q[-1]):
            found.append(moved + q.pop())
            if e:
                e.pop()
            continue
        if q[0] < q[-1] / 4:  # graded the other way; reversed, the values are the same
            q, e = q[::-1], e[::-1]
        # the least value of the last two rows is an upper bound of the least of all; take as much of it as goes
        x, y, z = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
        bound = (q[-2] * q[-1] + (e[-2] * y if len(e) > 1 else 0.0)) / ((x + y) / 2 + math.sqrt(((x - y) / 2) ** 2 + z))
        for part in (1 - 4 * _EPS, 0.99, 0.9, 0.5, 0.1, 0.0):
            if (after := qd_step(q, e, part * bound)) is not None:
                (q, e), moved = after, moved + part * bound
                break
    return np.array(sorted(found, reverse=True))


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stationary and progressive factors of B'B - value, and the twist terms."""
    m, tiny = len(a), np.finfo(float).tiny / _EPS
    q, e, ab = a * a, b * b, a[:-1] * b
    s, p, up, down = np.empty(m), np.empty(m), np.empty(m - 1), np.empty(m - 1)
    s[0], p[-1] = -value, q[-1] - value
    for i in range(m - 1):
        pivot = s[i] + q[i] or tiny
        up[i] = ab[i] / pivot
        s[i + 1] = up[i] * (b[i] / a[i]) * s[i] - value
    for i in range(m - 2, -1, -1):
        pivot = e[i] + p[i + 1] or tiny
        down[i] = ab[i] / pivot
        p[i] = p[i + 1] * (q[i] / pivot) - value
    return up, down, s + p + value


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an unreduced bidiagonal matrix for the leading values."""
    m, out, begun = len(a), [], 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-9 * values[j - 1]:
            begun = j
        near, kept = np.array(out[begun:j]).reshape(-1, m), None
        for attempt in range(m):
            for _ in range(3):
                up, down, twist = twisted(a, b, value)
                k = np.argsort(np.abs(twist))[attempt]
                z = np.ones(m)
                for i in range(k - 1, -1, -1):
                    z[i] = -up[i] * z[i + 1]
                for i in range(k, m - 1):
                    z[i + 1] = -down[i] * z[i]
                if begun < j or abs(twist[k]) <= _EPS * value * (z @ z):
                    break
                value += twist[k] / (z @ z)  # Rayleigh's correction
            z /= np.linalg.norm(z)
            rest = z - near.T @ (near @ z)
            if np.linalg.norm(rest) > 0.1:
                kept = rest - near.T @ (near @ rest)
                break
        out.append(kept / np.linalg.norm(kept) if kept is not None else z)
    return np.array(out).T.reshape(m, len(values))


def singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of r, falling, and the right singular vectors (columns) of the first `most`."""
    a, b, v = bidiagonal(r)
    scale = max(np.abs(a).max(), np.abs(b).max(initial=0))
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))[:, :most]
    # positive entries: signs go to rows and columns
    sign = np.ones(len(a))
    for i in range(len(b)):
        row = math.copysign(1, a[i]) * sign[i]
        sign[i + 1] = math.copysign(1, b[i]) * row
    a, b, v = np.maximum(np.abs(a), scale * 1e-100), np.abs(b), v * sign
    cuts = [0, *(i + 1 for i in range(len(b)) if b[i] <= _EPS * 1e-3 * math.sqrt(a[i] * a[i + 1])), len(a)]
    parts = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        values = dqds(a[lo:hi], b[lo : hi - 1])
        parts += [(x, lo, hi, j) for j, x in enumerate(values)]
    parts.sort(key=lambda x: -x[0])
    z = np.zeros((len(a), min(most, len(a))))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = [(at, x) for at, (x, begin, _, _) in enumerate(parts[:most]) if begin == lo]
        if own:
            z[lo:hi, [at for at, _ in own]] = directions(a[lo:hi], b[lo : hi - 1], np.array([x for _, x in own]))
    return np.array([x for x, *_ in parts]), v @ z


def triangle(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the centred rows of fit (x), by QR of blocks in tasks and of stacked triangles in a tree."""
    width = len(total)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            x = matrix(b.column("x"), width)
            for lo in range(0, len(x), ROWS):
                r = np.linalg.qr(np.concatenate([r, centred(x[lo : lo + ROWS], n, total).astype(float) / n]), mode="r")
        yield batch(part=pa.array(np.full(len(r), TaskContext.get().partitionId()), pa.int64()), at=pa.array(np.arange(len(r)), pa.int64()), row=pa.array(list(r), pa.list_(pa.float64())))

    def stacked(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("at").to_numpy(), t.column("part").to_numpy()))
        r = np.linalg.qr(matrix(t.column("row").combine_chunks(), width)[order], mode="r")
        part = t.column("part")[0].as_py() // FAN
        return pa.table({"part": pa.array(np.full(len(r), part), pa.int64()), "at": pa.array(np.arange(len(r)), pa.int64()), "row": pa.array(list(r), pa.list_(pa.float64()))})

    kind = "part long, at long, row array<double>"
    level = saved(fit.mapInArrow(blocks, kind), "triangles")
    while level.agg(F.max("part").alias("last")).first().last:
        above = saved(level.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(stacked, kind), "triangles")
        dropped(level)
        level = above
    rows = [r.row for r in level.orderBy("at").select("row").collect()]  # as many as a vector has entries
    dropped(level)
    r = np.zeros((width, width))
    r[: len(rows)] = np.array(rows).reshape(-1, width)
    return r


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            x = matrix(b.column("x"), width)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield batch(at=pa.array(np.arange(width), pa.int64()), n=pa.array(np.full(width, n), pa.int64()), high=pa.array(high), low=pa.array(low))

    rows = fit.mapInArrow(run, "at long, n long, high long, low long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("at").collect()
    return rows[0].n, [(r.high << 32) + r.low for r in rows]


def identity_error(fit: DataFrame, n: int, total: list[int], turn: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    width, k = turn.shape
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_y = np.zeros((k, k))
        for b in batches:
            y = centred(matrix(b.column("x"), width), n, total).astype(float) / n @ turn
            total_y += y.T @ y
        yield batch(at=pa.array(np.arange(k * k), pa.int64()), value=pa.array(total_y.ravel()))

    rows = fit.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return max(abs(r.value / n - (r.at % (k + 1) == 0)) for r in rows)


def whitening(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    kind = f"vec_id {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    entries = F.col("embedding").cast("array<double>")
    valid = vectors.select("vec_id", entries.alias("c")).where(F.size("c") > 0).where(F.forall("c", lambda c: c.isNotNull() & (F.abs(c) < _LARGE)))
    usual = valid.groupBy(F.size("c").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if usual is None:
        return spark.createDataFrame([], kind)
    width = usual.width
    rows = valid.where(F.size("c") == width).select("vec_id", F.transform("c", lambda c: F.floor(c * 64) + 1_000_000).alias("x"))
    fit = saved(rows.select("x").distinct(), "fit-list")
    n, total = sums(fit, width)
    r = triangle(fit, n, total)
    values, basis = singular(r, components)
    trace = float((r * r).sum())
    k = basis.shape[1]
    varies = values[:k] > width * _EPS**2 * trace * 16
    turn = basis / np.where(varies, np.sqrt(np.where(varies, values[:k], 1) / n), 1)
    error = identity_error(fit, n, total, turn[:, varies])
    dropped(fit)
    shared = spark.sparkContext.broadcast((n, total, turn, varies, values[:k] / trace if trace else None, error))  # 16 numbers a dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, turn, varies, explained, error = shared.value
        k = len(varies)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                x = matrix(b.column("x").slice(lo, ROWS), len(total))
                d = centred(x, n, total)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                again = lambda v: pa.array(np.tile(v, len(x)))
                none = pa.nulls(len(row), pa.float64())
                yield batch(
                    vec_id=b.column("vec_id").slice(lo, ROWS).take(row), component=again(np.arange(1, k + 1, dtype=np.int32)), n=pa.array(np.full(len(row), n), pa.int64()), deviation=deviations(d).take(row),
                    whitened=pa.array((d.astype(float) / n @ turn).ravel(), mask=~np.tile(varies, len(x))), explained=none if explained is None else again(np.where(varies, explained, 0.0)),
                    identity_error=none if error is None else pa.array(np.full(len(row), error)),
                )

    return rows.mapInArrow(run, kind)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
