"""Vectors against vectors in tiles: rows are dealt into tiles of a bounded size, a pair of tiles is one group, and a matrix product compares all of it. Joins by a threshold lay tiles around pivots and
skip the pairs of tiles that the triangle inequality on angles rules out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

TILE = 1024


def unit(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors; a null or zero vector is zero."""
    rows = [np.asarray(x, float) if x is not None else np.zeros(0) for x in column.to_pylist()]
    m = np.zeros((len(rows), max((len(x) for x in rows), default=0)))
    for i, x in enumerate(rows):
        m[i, : len(x)] = x
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dealt(df: DataFrame, keys: list[str], size: int, id_: str) -> DataFrame:
    """Columns _tile and _tiles: rows of the same keys in as many tiles as it takes for about `size` rows each."""
    n = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_tiles")) if keys else df.agg(F.ceil(F.count("*") / size).cast("int").alias("_tiles"))
    df = df.join(n, keys) if keys else df.crossJoin(F.broadcast(n))  # one row
    return df.withColumn("_tile", F.pmod(F.xxhash64(id_), F.col("_tiles")).cast("int"))


def angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ v.T, -1, 1))


def ringed(rows: DataFrame, keys: list[str], size: int, id_: str = "vec_id", most: int = 64) -> DataFrame:
    """Column ring: rows of the same keys cut by `angle` into rings of about `size` rows, at most `most` of them; a ring of more is dealt into parts."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("angle", F.array(*[F.lit(i / most) for i in range(1, most)]), 1000).alias("_b"))
    many = F.least(F.ceil(F.col("_n") / size), F.lit(most)).cast("int")
    inner = F.when(many > 1, F.transform(F.sequence(F.lit(1), F.greatest(many - 1, F.lit(1))), lambda i: F.get("_b", F.floor(i * most / many).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
    counts = counts.select(*keys, F.greatest(F.ceil(F.col("_n") / most / size), F.lit(1)).cast("int").alias("_parts"), inner.alias("_b"))
    ring = F.size(F.filter("_b", lambda x: x < F.col("angle"))) * F.col("_parts") + F.pmod(F.xxhash64(id_), F.col("_parts"))
    return rows.join(counts, keys).withColumn("ring", ring.cast("int")).drop("_b", "_parts")


PIVOTS = 256


def placed(vectors: DataFrame, block: list[str], size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Vectors with the tile they are in, and tiles with the pivot they lie around and the least and greatest angle to it. A block takes a pivot for each `size` rows, at most PIVOTS, in the order of a
    hash; its vectors go to the nearest, and around a pivot they are cut into rings. Null and zero vectors are left out."""
    length = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    v = vectors.select(*block, "vec_id", "embedding").where("embedding IS NOT NULL").where(length > 0)
    v = dealt(v, block, size, "vec_id")
    few = v.select(*block, "_tiles", "vec_id", "embedding").withColumn("pivot", F.row_number().over(W.partitionBy(*block).orderBy(F.xxhash64("vec_id"), "vec_id")).cast("int") - 1)
    few = few.where(F.col("pivot") < F.least("_tiles", F.lit(PIVOTS)))
    # a chunk of a block meets the block's pivots
    sent = few.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select(*block, "_tile", "pivot", F.col("embedding").alias("centre")).toDF(*block, "_tile", "pivot", "centre")
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}

    def file(t: pa.Table, pivots: pa.Table) -> pa.Table:
        out = t.select([*block, "vec_id", "embedding"])
        if not t.num_rows:
            return out.append_column("pivot", pa.array([], pa.int32())).append_column("angle", pa.array([], pa.float64()))
        far = angles(unit(t.column("embedding")), unit(pivots.column("centre")))
        near = far.argmin(axis=1)
        return out.append_column("pivot", pivots.column("pivot").combine_chunks().take(pa.array(near))).append_column("angle", pa.array(far[np.arange(len(near)), near]))

    fields = ", ".join(f"{c} {kinds[c]}" for c in (*block, "vec_id", "embedding")) + ", pivot int, angle double"
    filed = v.groupBy(*block, "_tile").cogroup(sent.groupBy(*block, "_tile")).applyInArrow(file, fields)
    rows, _ = written(ringed(filed, [*block, "pivot"], size).withColumn("tile", F.struct("pivot", "ring")).select(*block, "tile", "vec_id", "embedding", "angle"), "placed")
    stats = rows.groupBy(*block, "tile").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    return rows, stats.withColumn("pivot", F.col("tile.pivot")).join(few.select(*block, "pivot", F.col("embedding").alias("centre")), [*block, "pivot"]).drop("pivot")


def tile_pairs(tiles: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """Pairs of tiles (i <= j) of a block, and whether they are kept: by the triangle inequality on angles no vector of one lies within the threshold's angle of one of the other if not."""
    pivots = tiles.groupBy(*block, F.col("tile.pivot").alias("pivot")).agg(F.first("centre").alias("centre"))
    kinds = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in block)

    def between(t: pa.Table) -> pa.Table:  # at most PIVOTS rows
        u, n = unit(t.column("centre")), t.column("pivot").combine_chunks()
        at = np.arange(len(n))
        x, y = np.repeat(at, len(n)), np.tile(at, len(n))
        same = {c: pa.array([t.column(c)[0].as_py()] * len(x), t.schema.field(c).type) for c in block}
        return pa.table({**same, "p": n.take(pa.array(x)), "q": n.take(pa.array(y)), "gap": pa.array(np.where(x == y, 0.0, angles(u, u)[x, y]))})

    gaps = pivots.groupBy(*block).applyInArrow(between, (kinds + ", " if kinds else "") + "p int, q int, gap double")
    side = lambda name, low, high: tiles.select(*block, F.col("tile").alias(name), F.col("low").alias(low), F.col("high").alias(high), F.col("tile.pivot").alias("p" if name == "i" else "q"))
    j = side("i", "li", "hi").join(gaps, [*block, "p"]).join(side("j", "lj", "hj"), [*block, "q"]).where("i <= j")
    apart = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.col("gap") - F.col("hj"), F.col("lj") - F.col("gap")) - F.col("hi"), F.col("li") - F.col("gap") - F.col("hj"))
    return j.select(*block, "i", "j", (F.cos(F.least(apart, F.lit(np.pi))) >= threshold - 2e-6).alias("kept"))


def least_links(w: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of a minimum spanning forest of the links of weights w (inf: none), grown node by node. Rows and columns are the same nodes if alone, else all different ones."""
    rows, columns = w.shape
    nodes = rows if alone else rows + columns
    best, come, free = np.full(nodes, np.inf), np.zeros(nodes, np.int64), np.ones(nodes, bool)
    links, now = [], 0
    for _ in range(nodes):
        free[now], best[now] = False, np.inf
        to, row = (slice(0, rows), w[now]) if alone else (slice(rows, nodes), w[now]) if now < rows else (slice(0, rows), w[:, now - rows])
        nearer = (row < best[to]) & free[to]
        best[to][nearer], come[to][nearer] = row[nearer], now
        now = int(best.argmin())
        if best[now] < np.inf:
            links.append((come[now], now))
        elif free.any():
            now = int(free.argmax())
        else:
            break
    x, y = np.array(links, np.int64).reshape(-1, 2).T
    return (x, y) if alone else (np.minimum(x, y), np.maximum(x, y) - rows)


def similar_pairs(vectors: DataFrame, block: list[str], threshold: float, size: int = TILE, links: bool = False) -> DataFrame:
    """Pairs (a < b) of a block with cosine of at least threshold, rounded to six digits. A block of n rows is n / size tiles, so a large one is many groups; pairs of tiles that the threshold rules out
    are not made. With links, of a pair of tiles only as many pairs as hold its components together: fewer than its vectors, with the same components over all."""
    most = vectors.groupBy(*block).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n if block else vectors.count()
    if (most or 0) <= size or threshold <= 0:  # one tile a block, or zero vectors count: nothing to rule out
        v = dealt(vectors.select(*block, "vec_id", "embedding").where("embedding IS NOT NULL"), block, size, "vec_id")
        v = v.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        v = v.select(*block, F.least("_tile", "_k").alias("_i"), F.greatest("_tile", "_k").alias("_j"), (F.col("_tile") <= F.col("_k")).alias("_left"), "vec_id", "embedding")
    else:
        rows, tiles = placed(vectors, block, size)
        kept = tile_pairs(tiles, block, threshold).where("kept").select(*block, F.col("i").alias("_i"), F.col("j").alias("_j"))
        to = lambda name, left: rows.join(kept.withColumn("tile", F.col(name)) if left else kept.where("_i <> _j").withColumn("tile", F.col(name)), [*block, "tile"]).select(*block, "_i", "_j", F.lit(left).alias("_left"), "vec_id", "embedding")
        v = to("_i", True).unionByName(to("_j", False))
    kinds = {c: v.schema[c].dataType.simpleString() for c in (*block, "vec_id")}

    def run(t: pa.Table) -> pa.Table:
        ids, first = t.column("vec_id").to_numpy(), t.column("_left").to_numpy()
        alone = t.column("_i")[0].as_py() == t.column("_j")[0].as_py()
        u = unit(t.column("embedding"))
        left, right = np.flatnonzero(first), np.flatnonzero(first if alone else ~first)
        cosine = np.round(u[left] @ u[right].T, 6)
        near = cosine >= threshold
        if links and np.count_nonzero(near) > len(left) + len(right):
            x, y = least_links(np.where(near & (ids[left][:, None] != ids[right]), 2 - cosine, np.inf), alone)
            if alone:  # a link once, in either direction
                x, y = np.where(ids[left[x]] < ids[right[y]], x, y), np.where(ids[left[x]] < ids[right[y]], y, x)
        else:
            x, y = np.nonzero(near)
        a, b, c = ids[left[x]], ids[right[y]], cosine[x, y]
        keep = a < b if alone else a != b
        a, b, c = np.minimum(a, b)[keep], np.maximum(a, b)[keep], c[keep]
        same = {k: pa.array([t.column(k)[0].as_py()] * len(a), t.schema.field(k).type) for k in block}
        return pa.table({**same, "a": pa.array(a, t.schema.field("vec_id").type), "b": pa.array(b, t.schema.field("vec_id").type), "cosine": pa.array(c + 0.0)})

    fields = [*(f"{c} {kinds[c]}" for c in block), f"a {kinds['vec_id']}", f"b {kinds['vec_id']}", "cosine double"]
    return v.groupBy(*block, "_i", "_j").applyInArrow(run, ", ".join(fields))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, size: int = TILE) -> DataFrame:
    """query_id, vec_id, score: for each query (query_id, q) the k nearest of each tile of vectors (vec_id, embedding), among which the k nearest of all are; ties go to the smaller vec_id."""
    q = dealt(queries.select("query_id", "q").where("q IS NOT NULL"), [], size, "query_id").withColumnsRenamed({"_tile": "i", "_tiles": "ni"})
    v = dealt(vectors.select("vec_id", "embedding").where("embedding IS NOT NULL"), [], 4 * size, "vec_id").withColumnsRenamed({"_tile": "j", "_tiles": "nj"})
    many = lambda df, n: F.broadcast(df.agg(F.first(n).alias("n")))  # noqa: E731  one row
    q = q.crossJoin(many(v, "nj")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("i", "j", "query_id", "q")
    v = v.crossJoin(many(q.groupBy().agg((F.max("i") + 1).alias("ni")), "ni")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("i", "j", "vec_id", "embedding")
    kinds = (q.schema["query_id"].dataType.simpleString(), v.schema["vec_id"].dataType.simpleString())

    return q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(best_of_tile(k), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")


def best_of_tile(k: int):
    """query_id, vec_id, score: the k vectors of a tile (vec_id, embedding) nearest to each of some queries (query_id, q)."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, asked = b.column("vec_id").to_numpy(), a.column("query_id").to_numpy()
        if len(ids) and len(asked):
            order = np.argsort(ids, kind="stable")
            ids, s = ids[order], np.round(unit(a.column("q")) @ unit(b.column("embedding")).T, 6)[:, order]
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(asked)), top.shape[1])
            asked, ids, score = asked[row], ids[top.ravel()], s[row, top.ravel()]
        else:
            asked, ids, score = asked[:0], ids[:0], np.empty(0)
        return pa.table({"query_id": pa.array(asked, a.schema.field("query_id").type), "vec_id": pa.array(ids, b.schema.field("vec_id").type), "score": pa.array(score + 0.0)})

    return run
