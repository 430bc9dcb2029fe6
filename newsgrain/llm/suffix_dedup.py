"""Repeated byte strings by suffix sorting, one bucket at a time, with cover-sample ranks.

Only suffixes that could repeat are sorted. Each 400-byte window has an anchor, the place of the least 128-byte hash in it, so equal windows have equal anchors at equal distances. The windows
of a text that share an anchor lie together; the bytes they span are a piece. A suffix bucket is all pieces with one anchor hash. Where a piece occurs
again, all its windows repeat, and one shuffle of hashes tells so: 64 bits of the anchor's 128 bytes and 64 of the piece, so a false match needs a collision within one bucket. Texts are told apart by 64
bits and their length. Only buckets that hold different pieces are sorted, each distinct piece once.

In a bucket, suffixes are compared at equal distances from the anchor, so sample places every 16 bytes, counted from the anchor, are a difference cover for them. The samples' ranks by their next
384 bytes are computed first, by doubling. The suffix at distance t is then ordered by the t mod 16 bytes before its first sample, the sample's rank for the long tie, and
the bytes that are left of the 400; neighbours that agree in all three repeat. Memory is that of some thousand pieces. A bucket of more than `HOT` pieces is dealt out again by distance and by
the hash of the bytes that all windows of a range of distances have in common, which separates no two equal windows. Of rows with the same bytes at the same distance only one is sorted, and
what is found of it holds for all; a bucket that still has more than `HOT` different rows is not sorted: its windows are counted one by one, by hash.

A byte goes if a window over it repeats anywhere, its own text included; matches never cross texts. Null texts count as empty; texts under 400 bytes keep all. Equal texts of 400 bytes or more, and
repeated rows, lose everything. Very long texts go in stretches and lose no window at their edges. Of windows with equal hashes the leftmost is the anchor, in every text alike. A null doc_id changes nothing.
Columns of any name are carried untouched. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BYTE, STEP, U, as_long, batch, inverse, mixed, powers, rolling, text_blocks
from .common import dropped, saved, table
from .ngram_join import runs
from .substring_dedup import least

WINDOW, GRAM, EVERY = 400, 128, 16
HOT, RANGE, SEGMENT = 2048, 32, 2 << 20
Q = U(0xD6E8FEB86659FD93)
CUT = ["bucket", "t", "hash", "len"]
PIECE = "key long, size long, anchor long, piece long, start long, n int, t int"


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, piece hash, first window (within the text), number of windows, and the first window's distance from the anchor."""
    if len(data) < WINDOW:
        return tuple(np.empty(0, k) for k in (np.int64, U, U, np.int64, np.int64, np.int64))
    sym = BYTE[data]
    gram = rolling(sym, GRAM)
    low = least((gram >> U(32) << U(32)) | np.arange(len(gram), dtype=U), WINDOW - GRAM + 1) & U(0xFFFFFFFF)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(text[: len(data) - WINDOW + 1] == text[WINDOW - 1 :])
    where, owner = low[ok].astype(np.int64), text[ok]
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])])[: len(ok)])
    start, n = ok[first], np.diff(first, append=len(ok))
    place, end = where[first], start + n + WINDOW - 1
    total = np.zeros(len(sym) + 1, U)
    np.cumsum(sym * powers(len(sym), Q), out=total[1:])
    back = powers(len(sym) + 1, inverse(Q))
    t = place - start
    piece = mixed((total[end] - total[start]) * back[start] + mixed(t.astype(U) * STEP + n.astype(U)))
    return owner[first], mixed(gram[place]), piece, start - at[owner[first]], n, t


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> a row for each piece of each text."""
    for b in batches:
        for lo, hi, data, at in text_blocks(b.column("text")):
            keys, sizes = b.column("key").to_numpy()[lo:hi], np.diff(at)
            for s in range(0, max(1, len(data)), SEGMENT):  # one long text goes in stretches of windows
                if hi - lo > 1:
                    part, off, step = data, at, 0
                else:
                    part = data[s : s + SEGMENT + WINDOW - 1]
                    off, step = np.array([0, len(part)]), s
                owner, anchor, piece, start, n, t = pieces(part, off)
                yield batch(key=pa.array(keys[owner]), size=pa.array(sizes[owner], pa.int64()), anchor=as_long(anchor), piece=as_long(piece), start=pa.array(start + step, pa.int64()), n=pa.array(n, pa.int32()), t=pa.array(t, pa.int32()))
                if hi - lo > 1:
                    break


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, wanted pieces -> their bytes, by bucket; skip: where in the piece the bytes begin."""
    for b in batches:
        for lo, hi, data, at in text_blocks(b.column("text")):
            raw, out = data.tobytes(), []
            for k, want in enumerate(b.column("want").slice(lo, hi - lo).to_pylist()):
                for w in want:
                    begin, n, t = int(at[k]) + w["start"], w["n"], w["t"]
                    if not w["hot"]:
                        out.append((w["anchor"], w["anchor"], w["piece"], 0, t, raw[begin : begin + n + WINDOW - 1]))
                        continue
                    for r in range((t - n + 1) // RANGE, t // RANGE + 1):
                        top, last = min(t, r * RANGE + RANGE - 1), max(t - n + 1, r * RANGE)  # distances, from the left
                        a = begin + t - top
                        common = begin + t - r * RANGE
                        core = rolling(BYTE[np.frombuffer(raw[common : common + WINDOW - RANGE + 1], np.uint8)], WINDOW - RANGE + 1)[0]
                        bucket = int(mixed(np.array([core ^ U(w["anchor"] % 2**64)], U) + U(r) * STEP).view(np.int64)[0])
                        out.append((bucket, w["anchor"], w["piece"], t - top, top, raw[a : a + top - last + WINDOW]))
                    if len(out) > 4096:
                        yield _cut(out)
                        out = []
            if out:
                yield _cut(out)


def _cut(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return batch(**{k: pa.array(x, t) for k, x, t in zip(("bucket", "anchor", "piece", "skip", "t", "bytes"), zip(*rows, strict=True), kinds, strict=True)})


def ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense rank of rows by keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; the end is padded."""
    d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    out = np.zeros(len(data), U)
    for k in range(8):
        out |= d[k : k + len(data)] << U(56 - 8 * k)
    return out


def shifted(hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n (0 to 8) of 8 packed bytes."""
    return np.where(n >= 8, hi, hi & ~(U(0xFFFFFFFFFFFFFFFF) >> (U(8) * np.minimum(n, 7).astype(U))))


def sorted_suffixes(bucket: np.ndarray, t: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of some buckets, their bytes in a row -> (piece, window within it) of the suffixes that agree with another of the bucket in 400 bytes."""
    begin = np.cumsum(size) - size
    word = eight(data)
    # samples: places whose distance from the anchor is a multiple of EVERY
    lead = t % EVERY
    count = np.maximum(0, (size - lead + EVERY - 1) // EVERY)
    of = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    place = begin[of] + lead[of] + nth * EVERY
    ahead = lambda r, k: r[np.minimum(np.arange(len(r)) + k, len(r) - 1)]
    rank = ranked(word[place], word[np.minimum(place + 8, len(word) - 1)])  # 16 bytes
    for k in (1, 2, 4):
        rank = ranked(rank, ahead(rank, k))
    half = rank  # 128 bytes
    rank = ranked(ranked(half, ahead(half, 8)), ahead(half, 16))  # 384 bytes
    # the suffixes to sort
    n = size - WINDOW + 1
    own = np.repeat(np.arange(len(size)), n)
    j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    far = t[own] - j
    gap = far % EVERY
    sample = (np.cumsum(count) - count)[own] + (j + gap - lead[own]) // EVERY
    p = begin[own] + j
    tail, left = p + gap + WINDOW - EVERY, EVERY - gap
    end = len(word) - 1
    keys = [
        (bucket[own].astype(np.int64) << 9 | far) << 32 | rank[sample],
        shifted(word[p], gap),
        shifted(word[np.minimum(p + 8, end)], np.maximum(0, gap - 8)),
        shifted(word[np.minimum(tail, end)], left),
        shifted(word[np.minimum(tail + 8, end)], np.maximum(0, left - 8)),
    ]
    r = ranked(*keys)
    again = np.flatnonzero(np.bincount(r)[r] > 1)
    return own[again], j[again]


def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of cut_out with their number of times, sorted by bucket -> the stretches (first, last window) that repeat."""
    held, rows = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        _, bucket = np.unique(t.column("bucket").to_numpy(), return_inverse=True)
        raw = t.column("bytes").to_pylist()
        own, j = sorted_suffixes(bucket, t.column("t").to_numpy().astype(np.int64), np.array([len(x) for x in raw]), np.frombuffer(b"".join(raw), np.uint8))
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (j[1:] != j[:-1] + 1)])[: len(own)])
        last = np.append(first, len(own))[1:] - 1
        whole = np.flatnonzero(t.column("times").to_numpy() > 1)
        at = np.concatenate([own[first], whole]).astype(np.int64)
        if len(at):
            a, z = np.concatenate([j[first], np.zeros(len(whole), np.int64)]), np.concatenate([j[last], t.column("len").to_numpy()[whole] - WINDOW])
            yield batch(**{k: pa.array(t.column(k).to_numpy()[at]) for k in CUT}, a=pa.array(a, pa.int32()), z=pa.array(z, pa.int32()))

    for _, t in runs(batches, ["bucket"], most=1 << 30):
        held.append(t)
        rows += t.num_rows
        if rows >= 2048:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of cut_out with their number of times -> a row for each window: its place, distance and hash."""
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            raw = part.column("bytes").to_pylist()
            n = np.array([len(x) - WINDOW + 1 for x in raw])
            own = np.repeat(np.arange(len(raw)), n)
            j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            w = np.concatenate([rolling(BYTE[np.frombuffer(x, np.uint8)], WINDOW) for x in raw])
            far = part.column("t").to_numpy()[own] - j
            yield batch(**{k: pa.array(part.column(k).to_numpy()[own]) for k in (*CUT, "times")}, j=pa.array(j, pa.int32()), far=pa.array(far, pa.int32()), w=as_long(w))


def repeated(cut: DataFrame) -> DataFrame:
    """Saved rows of cut_out with hash and len of their bytes -> bucket, t, hash, len and the stretches that repeat."""
    big = saved(cut.select(*CUT).distinct().groupBy("bucket").agg(F.count("*").alias("g")).where(F.col("g") > HOT).select("bucket"), "big")
    distinct = lambda rows: rows.groupBy(*CUT).agg(F.count("*").alias("times"), F.first("bytes").alias("bytes"))
    spans = distinct(cut.join(big, "bucket", "left_anti")).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sorted_buckets, "bucket long, t int, hash long, len int, a int, z int")
    if big.isEmpty():
        return spans
    one = distinct(cut.join(big, "bucket", "left_semi")).mapInArrow(single_windows, "bucket long, t int, hash long, len int, times long, j int, far int, w long")
    one = saved(one, "windows")
    again = one.groupBy("bucket", "far", "w").agg(F.count("*").alias("n"), F.max("times").alias("most")).where("n > 1 OR most > 1")
    return spans.unionByName(one.join(again, ["bucket", "far", "w"], "left_semi").select(*CUT, F.col("j").alias("a"), F.col("j").alias("z")))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text, spans -> row, n_bytes, n_removed, n_spans, kept."""
    for b in batches:
        for lo, hi, data, at in text_blocks(b.column("text")):
            n, spans, kept = [], [], []
            for k, cut in enumerate(b.column("spans").slice(lo, hi - lo).to_pylist()):
                own = data[at[k] : at[k + 1]]
                if cut:
                    cover = np.zeros(len(own) + 1, np.int64)
                    a = np.array([[c["a"], c["z"]] for c in cut])
                    np.add.at(cover, a[:, 0], 1)
                    np.add.at(cover, a[:, 1] + WINDOW, -1)
                    off = np.cumsum(cover[:-1]) > 0
                    n.append(int(off.sum()))
                    spans.append(int(off[0]) + int((off[1:] & ~off[:-1]).sum()))
                    own = own[~off]
                else:
                    n.append(0)
                    spans.append(0)
                kept.append(own.tobytes())
            yield batch(row=b.column("row").slice(lo, hi - lo), n_bytes=pa.array(np.diff(at), pa.int64()), n_removed=pa.array(n, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept=pa.array(kept, pa.binary()))


def suffix_dedup(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Struct `row` of the carried columns, n_bytes, n_removed, n_spans and kept (binary), for each row of docs."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("key", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("long"))
    every = d.where(F.col("size") >= WINDOW).select("key", "text").mapInArrow(found, PIECE)
    occ = saved(every.groupBy("key", "size", "anchor", "piece", "start", "n", "t").agg(F.count("*").alias("times")), "pieces")
    seen = occ.groupBy("anchor", "piece").agg(F.sum("times").alias("times"), F.min(F.struct("key", "size", "start", "n", "t")).alias("at"))
    seen = saved(seen, "distinct")
    # buckets that hold different pieces, one of them not yet known to repeat
    open_ = seen.groupBy("anchor").agg(F.count("*").alias("g"), F.min("times").alias("least")).where("g > 1 AND least = 1")
    want = seen.join(open_.select("anchor", (F.col("g") > HOT).alias("hot")), "anchor")
    want = want.groupBy("at.key", "at.size").agg(F.collect_list(F.struct("at.start", "at.n", "at.t", "anchor", "piece", "hot")).alias("want"))
    texts = d.where(F.col("size") >= WINDOW).select(F.col("key").alias("k"), F.col("size").alias("s"), "text")
    # equal texts hold equal pieces; sorting takes them once more, which is the same as once
    cut = want.join(texts, (F.col("key") == F.col("k")) & (F.col("size") == F.col("s"))).select("text", "want")
    cut = cut.mapInArrow(cut_out, "bucket long, anchor long, piece long, skip int, t int, bytes binary").withColumns({"hash": F.xxhash64("bytes"), "len": F.octet_length("bytes")})
    cut = saved(cut, "cut")
    spans = saved(repeated(cut), "stretches")
    spans = cut.select(*CUT, "anchor", "piece", "skip").join(spans, CUT).select("anchor", "piece", (F.col("skip") + F.col("a")).alias("a"), (F.col("skip") + F.col("z")).alias("z")).distinct()
    spans = saved(spans, "spans")
    whole = seen.where("times > 1").select("anchor", "piece", F.lit(0).alias("a"), (F.col("at.n") - 1).alias("z"))
    verdict = occ.join(spans.unionByName(whole), ["anchor", "piece"]).select("key", "size", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z"))
    verdict = saved(verdict.groupBy(F.col("key").alias("k"), F.col("size").alias("s")).agg(F.collect_list(F.struct("a", "z")).alias("spans")), "verdict")
    dropped(occ, seen, cut, spans)
    rows = d.join(verdict, (F.col("key") == F.col("k")) & (F.col("size") == F.col("s")), "left").select("row", "text", "spans")
    return rows.mapInArrow(removed, f"row {d.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
