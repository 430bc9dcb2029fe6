"""Substring deduplication against a log-structured index of window fingerprints.

A window is 50 consecutive words. Documents come in batches of ascending doc_id. The index is a list of immutable runs; a run holds, for each shard, the sorted
fingerprints of the windows that were new in its batch. A new batch is dealt out by shard and merge-joined with the history: a window whose fingerprint is in a run, or in the batch
under a smaller doc_id, is a repeat. A match is verified by 32 independent bits beside the 64 of the fingerprint. What is new becomes the next run; before another batch comes, the two runs
are compacted into one. Runs are tables bucketed by shard, so the history is read and compacted where it lies and only the batch is shuffled. There are as many shards as keep a shard's history
near `PER_SHARD` windows.

The shard of a window comes from its least 8-word hash, so neighbouring windows of a document stay together and the answers come back in few rows.

A passage in a good part of all documents would send all of these to one shard. So windows that stand out are found first: those in more than one of `SHARE` documents of some stretch of the table.
Only their first document has to be known, so each task sends one row for each of them, the least doc_id; the answer, one pair for each, goes to all tasks. There are at most 2 * SHARE times as many
as a document has windows on average, however large the table.

Null texts have no words. A row with a null doc_id is kept whole and is not indexed. Rows that repeat a doc_id do not remove each other. Very long texts are taken whole. doc_id is a whole
number; ties (equal windows of one document) are no repeats. Columns of any name are carried untouched. An empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U, as_long, batch, mixed, rolling, text_blocks, word_hashes
from .common import dropped, saved, shared_dir, table

WINDOW, GRAM, BATCHES = 50, 8, 4
CHECK = U(0xA0761D6478BD642F)
SHARE, PER_SHARD = 256, 2_000_000
RUN = "shard int, h binary, c binary"


def packed(h: np.ndarray) -> bytes:
    """Sorted fingerprints as differences, byte by byte: what they share compresses away."""
    return np.ascontiguousarray(np.diff(h, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n, span, low = len(values) - width + 1, 1, values
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


def windows(words: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, check bits, shard value and text number of each window that lies within one text."""
    if len(words) < WINDOW:
        return np.empty(0, U), np.empty(0, np.uint32), np.empty(0, U), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    inside = text[: len(words) - WINDOW + 1] == text[WINDOW - 1 :]
    near = least(rolling(words, GRAM), WINDOW - GRAM + 1)
    check = (rolling(words, WINDOW, CHECK) >> U(32)).astype(np.uint32)
    return rolling(words, WINDOW)[inside], check[inside], mixed(near[inside]), text[: len(inside)][inside]


def standing_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> fingerprints in more than one of SHARE documents of a stretch, with that number; and a row (h null) with how many windows the stretch has."""
    held, size, docs = [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, U), np.empty(0, np.int64))
        often = n > max(4, docs // SHARE)
        yield batch(h=pa.concat_arrays([as_long(h[often]), pa.nulls(1, pa.int64())]), n=pa.array(np.append(n[often], size), pa.int64()))

    for b in batches:
        for lo, hi, data, at in text_blocks(b.column("text")):
            words, _, wo = word_hashes(data, at)
            h, _, _, text = windows(words, wo)
            docs, size = docs + hi - lo, size + len(h)
            # a document counts once for each window
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            held.append(h[new])
        if sum(map(len, held)) >= 2 << 20:
            yield from flush()
            held, size, docs = [], 0, 0
    yield from flush()


def dealt(shards: int, often: np.ndarray):
    """doc_id, text -> a row for each shard and some million windows: fingerprints sorted, with check bits and documents. Windows that stand out (often: sorted fingerprints) go to shard -1, once for each
    stretch with the least doc_id."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, c, s, d = (np.concatenate(x) for x in zip(*held, strict=True))
        s = (s % U(shards)).astype(np.int32)
        if len(often):
            out = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
            if out.any():
                oh, oc, od = h[out], c[out], d[out]
                order = np.lexsort((od, oc, oh))
                oh, oc, od = oh[order], oc[order], od[order]
                first = np.ones(len(oh), bool)
                first[1:] = (oh[1:] != oh[:-1]) | (oc[1:] != oc[:-1])
                yield batch(**{k: pa.array([v], t) for k, v, t in (("shard", -1, pa.int32()), ("h", oh[first].tobytes(), pa.binary()), ("c", oc[first].tobytes(), pa.binary()), ("ids", od[first].tobytes(), pa.binary()), ("at", b"", pa.binary()))})
            h, c, s, d = h[~out], c[~out], s[~out], d[~out]
        order = np.lexsort((h, s))
        h, c, s, d = h[order], c[order], s[order], d[order]
        starts = np.flatnonzero(np.diff(s, prepend=-1))
        ends = [*starts[1:], len(s)]
        for k in range(0, len(starts), 512):
            part = list(zip(starts[k : k + 512], ends[k : k + 512], strict=True))
            names = [np.unique(d[a:b], return_inverse=True) for a, b in part]
            yield batch(
                shard=pa.array(s[starts[k : k + 512]]),
                h=pa.array([packed(h[a:b]) for a, b in part], pa.binary()),
                c=pa.array([c[a:b].tobytes() for a, b in part], pa.binary()),
                ids=pa.array([n.tobytes() for n, _ in names], pa.binary()),
                at=pa.array([i.astype(np.uint16 if len(n) <= 65536 else np.uint32).tobytes() for n, i in names], pa.binary()),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, _, data, at in text_blocks(b.column("text")):
                words, _, wo = word_hashes(data, at)
                h, c, s, text = windows(words, wo)
                if len(h):
                    held.append((h, c, s, ids[lo + text]))
                    size += len(h)
                if size >= max(1 << 20, 200 * shards):
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def in_run(h: np.ndarray, c: np.ndarray, run_h: np.ndarray, run_c: np.ndarray) -> np.ndarray:
    if not len(run_h):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(run_h, h), len(run_h) - 1)
    return (run_h[at] == h) & (run_c[at] == c)


def merge_join(new: pa.Table, runs: pa.Table) -> pa.Table:
    """One shard: rows (doc_id, its repeated fingerprints), and the row of the next run."""
    out = {"shard": [], "doc_id": [], "h": [], "c": []}
    if new.num_rows:
        shard = new.column("shard")[0].as_py()
        if shard < 0:
            return _firsts(new)
        cols = [new.column(k).to_pylist() for k in ("h", "c", "ids", "at")]
        h, c, d = [], [], []
        for bh, bc, ids, at in zip(*cols, strict=True):
            h.append(unpacked(bh))
            c.append(np.frombuffer(bc, np.uint32))
            d.append(np.frombuffer(ids, np.int64)[np.frombuffer(at, np.uint16 if len(at) == 2 * len(h[-1]) else np.uint32)])
        h, c, d = np.concatenate(h), np.concatenate(c), np.concatenate(d)
        order = np.lexsort((d, c, h))
        h, c, d = h[order], c[order], d[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        starts = np.flatnonzero(first)
        repeat = d > np.repeat(d[starts], np.diff(starts, append=len(h)))
        known = np.zeros(len(starts), bool)
        for rh, rc in zip(runs.column("h").to_pylist(), runs.column("c").to_pylist(), strict=True):
            known |= in_run(h[starts], c[starts], unpacked(rh), np.frombuffer(rc, np.uint32))
        repeat |= np.repeat(known, np.diff(starts, append=len(h)))
        rd, rh = d[repeat], h[repeat]
        order = np.argsort(rd, kind="stable")
        rd, rh = rd[order], rh[order]
        at = np.flatnonzero(np.concatenate([[True], rd[1:] != rd[:-1]])) if len(rd) else np.empty(0, np.int64)
        for a, b in zip(at, [*at[1:], len(rd)], strict=False):
            out["shard"].append(shard)
            out["doc_id"].append(int(rd[a]))
            out["h"].append(np.unique(rh[a:b]).tobytes())
            out["c"].append(None)
        fresh = starts[~known]
        out["shard"].append(shard)
        out["doc_id"].append(None)
        out["h"].append(packed(h[fresh]))
        out["c"].append(c[fresh].tobytes())
    return pa.table({"shard": pa.array(out["shard"], pa.int32()), "doc_id": pa.array(out["doc_id"], pa.int64()), "h": pa.array(out["h"], pa.binary()), "c": pa.array(out["c"], pa.binary())})


def _firsts(new: pa.Table) -> pa.Table:
    """Windows that stand out -> a row with each of them, and its least doc_id in place of check bits' documents."""
    h, c, d = (np.concatenate([np.frombuffer(b, t) for b in new.column(k).to_pylist()]) for k, t in (("h", U), ("c", np.uint32), ("ids", np.int64)))
    order = np.lexsort((d, c, h))
    h, c, d = h[order], c[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return pa.table({"shard": pa.array([-1], pa.int32()), "doc_id": pa.nulls(1, pa.int64()), "h": pa.array([h[first].tobytes() + d[first].tobytes()], pa.binary()), "c": pa.array([c[first].tobytes()], pa.binary())})


def compacted(one: pa.Table, other: pa.Table) -> pa.Table:
    """Two runs of one shard as one sorted run."""
    rows = pa.concat_tables([one, other])
    h = np.concatenate([unpacked(b) for b in rows.column("h").to_pylist()])
    c = np.concatenate([np.frombuffer(b, np.uint32) for b in rows.column("c").to_pylist()])
    order = np.argsort(h, kind="stable")
    return pa.table({"shard": rows.column("shard").slice(0, 1), "doc_id": pa.nulls(1, pa.int64()), "h": pa.array([packed(h[order])], pa.binary()), "c": pa.array([c[order].tobytes()], pa.binary())})


class Index:
    """Runs of window fingerprints, each a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, n_windows: int = 0, often: np.ndarray | None = None) -> None:
        """n_windows: about how many there will be; often: sorted fingerprints of windows that stand out."""
        self.spark, self.runs, self.firsts = spark, [], []
        self.buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.shards = max(4 * self.buckets, -(-n_windows // PER_SHARD))
        self.often = often if often is not None else np.empty(0, U)

    def _write(self, rows: DataFrame) -> str:
        """rows come out of a (co)group by shard, so each task holds whole buckets and nothing is shuffled again."""
        name = f"run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, "shard").sortBy("shard").option("compression", "zstd").option("path", path).saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("doc_id IS NULL AND shard >= 0").select("shard", "h", "c")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def add(self, docs: DataFrame) -> DataFrame:
        """Index docs (doc_id, text), all of later doc_ids than those before; doc_id and fingerprints of their repeats."""
        if len(self.runs) > 1:
            self.compact()
        history = self._run(self.runs[0]) if self.runs else self.spark.createDataFrame([], RUN)
        new = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(dealt(self.shards, self.often), "shard int, h binary, c binary, ids binary, at binary")
        found = new.groupBy("shard").cogroup(history.groupBy("shard")).applyInArrow(merge_join, "shard int, doc_id long, h binary, c binary")
        self.runs.append(self._write(found))
        self.firsts += self.spark.table(self.runs[-1]).where("shard < 0").select("h", "c").collect() if len(self.often) else []  # one row
        return saved(self.spark.table(self.runs[-1]).where("doc_id IS NOT NULL").select("doc_id", "h"), "repeats")

    def compact(self) -> None:
        old = self.runs
        one, other = (self._run(name).groupBy("shard") for name in old)
        self.runs = [self._write(one.cogroup(other).applyInArrow(compacted, "shard int, doc_id long, h binary, c binary"))]
        for name in old:
            self._drop(name)
        self.spark._jvm.System.gc()  # lets Spark clean the shuffle files of the batches before

    def first_documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that stand out: fingerprints in order, check bits, and the first document."""
        h, c, d = [np.empty(0, U)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for r in self.firsts:
            n = len(r.c) // 4
            h.append(np.frombuffer(bytes(r.h[: 8 * n]), U))
            d.append(np.frombuffer(bytes(r.h[8 * n :]), np.int64))
            c.append(np.frombuffer(bytes(r.c), np.uint32))
        h, c, d = np.concatenate(h), np.concatenate(c), np.concatenate(d)
        order = np.lexsort((d, c, h))
        h, c, d = h[order], c[order], d[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        return h[first], c[first], d[first]

    def close(self) -> None:
        for name in self.runs:
            self._drop(name)
        self.runs = []


def cleaned(shared):
    """row, doc, text, repeats -> row, n_words, n_removed, kept (words joined by one space). shared: what first_documents() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oh, oc, od = shared.value
        for b in batches:
            docs = b.column("doc").fill_null(-(2**63)).to_numpy()  # a row without doc_id comes before all
            for lo, hi, data, at in text_blocks(b.column("text")):
                words, starts, wo = word_hashes(data, at)
                print_of, raw, n, gone, kept = rolling(words, WINDOW), data.tobytes(), [], [], []
                later = np.zeros(len(print_of), bool)
                if len(oh) and len(print_of):
                    i = np.searchsorted(oh, print_of)
                    maybe = np.flatnonzero(oh[np.minimum(i, len(oh) - 1)] == print_of)
                    if len(maybe):
                        check, owner = (rolling(words, WINDOW, CHECK) >> U(32)).astype(np.uint32), docs[lo + np.repeat(np.arange(hi - lo), np.diff(wo))[: len(print_of)]]
                        for k in range(4):  # fingerprints that differ only in their check bits lie side by side
                            j = np.minimum(i[maybe] + k, len(oh) - 1)
                            later[maybe] |= (oh[j] == print_of[maybe]) & (oc[j] == check[maybe]) & (od[j] < owner[maybe])
                for k, blobs in enumerate(b.column("repeats").slice(lo, hi - lo).to_pylist()):
                    a, e = int(wo[k]), int(wo[k + 1])
                    own = raw[at[k] : at[k + 1]].split()
                    removed = 0
                    if e - a >= WINDOW and (blobs or later[a : e - WINDOW + 1].any()):
                        hit = later[a : e - WINDOW + 1]
                        if blobs:
                            hit = hit | np.isin(print_of[a : e - WINDOW + 1], np.frombuffer(b"".join(blobs), U))
                        cover = np.zeros(e - a + 1, np.int64)
                        cover[: len(hit)] += hit
                        cover[WINDOW : WINDOW + len(hit)] -= hit
                        off = np.cumsum(cover[:-1]) > 0
                        removed = int(off.sum())
                        own = [own[i] for i in np.flatnonzero(~off)]
                    n.append(e - a)
                    gone.append(removed)
                    kept.append(b" ".join(own))
                yield batch(row=b.column("row").slice(lo, hi - lo), n_words=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), kept=pa.array(kept, pa.binary()).cast(pa.string()))

    return run


def substring_dedup(docs: DataFrame, carry: list[str], batches: int = BATCHES) -> DataFrame:
    """Struct `row` of the carried columns, n_words, n_removed and kept, for each row of docs."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / batches) for k in range(1, batches)]) if batches > 1 else F.array(F.lit(0.5)), 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    seen = saved(docs.where("doc_id IS NOT NULL").select("text").mapInArrow(standing_out, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "standing-out")
    total, rows = seen.where("h IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], docs.count()
    # in at least one of 2 * SHARE documents of all: no more than 2 * SHARE times the windows of an average document
    often = np.sort(np.array([r.h for r in seen.where((F.col("h").isNotNull()) & (F.col("n") > max(16, rows // (2 * SHARE)))).select("h").collect()], np.int64).view(U))
    dropped(seen)
    index, repeats = Index(spark, total, often), None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs if lo is None else docs.where(F.col("doc_id") > lo)
        found = index.add(part if hi is None else part.where(F.col("doc_id") <= hi))
        repeats = found if repeats is None else repeats.unionByName(found)
    firsts = spark.sparkContext.broadcast(index.first_documents())
    index.close()
    by_doc = repeats.groupBy("doc_id").agg(F.collect_list("h").alias("repeats")).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("doc_id").alias("_doc"), F.col("text"))
    rows = rows.join(by_doc, F.col("_doc") == F.col("_id"), "left").select("row", F.col("_doc").cast("long").alias("doc"), "text", "repeats")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(cleaned(firsts), f"row {kind}, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE doc_id > first),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM m, (SELECT unnest(range(0, 50)) AS k)),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
k AS (SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i WHERE c.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
