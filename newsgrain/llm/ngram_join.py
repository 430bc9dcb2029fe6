"""Similarity join on sets of word 5-grams (Jaccard of at least 80 %), as connected groups.

Texts with equal sets are one class, kept by its smallest doc_id. Classes meet in tiles: a tile is a size band of the sets that agree in three
min-hashes at once, of 40 such triples. Two sets of similarity 0.8 share no triple with a probability of 0.488**40 < 1e-12, and more similar ones less; there is no cap on a
tile. In a tile, sets are taken in order of size, so that a set meets only those up to 1.25 times as large. Each set has a bitmap signature as wide as
the set, in which every shingle flips one hashed bit. Two signatures that differ in h bits belong to sets that differ in at least h shingles, so (n1 + n2 - h) / 2 bounds the
overlap from above; only pairs that could still link go on to the exact intersection of their sorted arrays, made again from the whole texts.

Groups of near copies are joined in steps, so that a group of g makes about g exact comparisons and not g squared: first each set is compared with the first
set (hub) of its tiles; then, in tiles that still hold several components, with its nearest set of another component by the signatures, again and again until that joins nothing
more; last, tiles with several components compare everything across these. Large tiles are dealt out in pairs of blocks of rows. No link between components
is left out, since the last step takes every tile with two components in full.

Null and empty texts have no shingles and are linked with nothing. Very long texts have all their shingles. Rows that repeat a doc_id count as one document with several texts. A row with a null
doc_id gets the component of its equal texts, null if there are none. A similarity of exactly 0.8 links. Sets of one size are taken in order of doc_id. Other columns, of any name, are not read. An
empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import STEP, U, as_long, batch, lists, mixed, rolling, text_blocks, word_hashes
from .common import collecting, dropped, saved, table
from .components import components

WORDS, TRIPLES, ROWS = 5, 40, 3
LINK_PERCENT = 80
BLOCK_ROWS = 4096
_rng = np.random.Generator(np.random.PCG64(5))
TURNS = (_rng.integers(0, 2**31, TRIPLES * ROWS) * 2 + 1).astype(np.uint32)[:, None]
SPREAD = (_rng.integers(0, 2**62, TRIPLES * ROWS) * 2 + 1).astype(U).reshape(TRIPLES, ROWS)


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; of a shorter text, one of all its words."""
    words, _, wo = word_hashes(data, at, lower=True)
    grams, out = rolling(words, n), []
    for lo, hi in zip(wo[:-1], wo[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        else:
            out.append(rolling(words[lo:hi], hi - lo) if hi > lo else np.empty(0, U))
    return out


def min_hashes(s: np.ndarray) -> np.ndarray:
    """TRIPLES keys: each mixes ROWS minima of the set under different multiplications."""
    s = (s >> U(32)).astype(np.uint32)
    low = np.full(TRIPLES * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(s), 1024):
        np.minimum(low, (s[None, k : k + 1024] * TURNS).min(axis=1), out=low)
    return mixed((low.reshape(TRIPLES, ROWS).astype(U) * SPREAD).sum(axis=1, dtype=U) + np.arange(TRIPLES, dtype=U) * STEP)


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap of at least 4 * len(s) bits, a power of two: so wide that few of the shingles in which two near sets differ cancel out."""
    width = max(64, 1 << int(4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sig: np.ndarray, width: int) -> np.ndarray:
    """A signature (bytes, last axis) folded to a smaller width: still one flip a shingle."""
    while sig.shape[-1] * 8 > width:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


def may_link(n1, n2, bits) -> np.ndarray:
    """Whether an overlap of (n1 + n2 - bits) / 2 suffices: 100 * i >= 80 * (n1 + n2 - i)."""
    most = (n1 + n2 - bits) // 2
    return (100 + LINK_PERCENT) * most >= LINK_PERCENT * (n1 + n2)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, at in text_blocks(b.column("text")):
            sets = shingle_sets(data, at)
            both = [np.array([x.sum(dtype=U), mixed(x ^ STEP).sum(dtype=U)]) for x in sets]
            big = [len(x) >= 4 for x in sets]  # smaller sets link only if they are equal
            yield batch(
                doc_id=b.column("doc_id").slice(lo, hi - lo),
                n_shingles=pa.array([len(x) for x in sets], pa.int64()),
                d1=as_long(np.array([x[0] for x in both], U)),
                d2=as_long(np.array([x[1] for x in both], U)),
                cells=lists([min_hashes(x) if k else np.empty(0, U) for x, k in zip(sets, big, strict=True)]),
                sig=pa.array([signature(x) if k else b"" for x, k in zip(sets, big, strict=True)], pa.binary()),
            )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 17) -> Iterator[tuple[bool, pa.Table]]:
    """(goes on from the run before, rows) of equal keys, from batches sorted by them; a longer run comes in parts of about most rows."""
    rest, last = None, None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        at = np.ones(t.num_rows, bool)
        if t.num_rows:
            at[1:] = np.any([(c := t.column(k).to_numpy())[1:] != c[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(at)
        cut = [*starts[1:], *([t.num_rows] if t.num_rows - (starts[-1] if len(starts) else 0) >= most else [])]
        lo = 0
        for hi in cut:
            key = tuple(t.column(k)[lo].as_py() for k in keys) if hi - lo >= most or last is not None else None
            yield key is not None and key == last, t.slice(lo, hi - lo)
            last = key if hi - lo >= most else None
            lo = hi
        rest = t.slice(lo)
    if rest is not None and rest.num_rows:
        key = tuple(rest.column(k)[0].as_py() for k in keys)
        yield key == last, rest


def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles with company, sorted by cell and size, each with the hub of its size band: the first set that is at least 0.8 times as large."""
    rest, hub, hub_n, cell = None, 0, -1, None
    for b in batches:
        t = pa.Table.from_batches([b])
        cells, n, rep = (t.column(k).to_numpy() for k in ("cell", "n", "rep"))
        if rest is not None:
            cells, n, rep = (np.concatenate([x, y]) for x, y in zip(rest, (cells, n, rep), strict=True))
        if len(cells) < 2:
            rest = (cells, n, rep)
            continue
        # the last row waits: whether it has company is seen in the next batch
        same = cells[1:] == cells[:-1]
        company = np.concatenate([[len(cells) > 0 and cells[0] == cell], same]) | np.concatenate([same, [False]])
        out, hub, hub_n, cell = _hubs(cells[:-1], n[:-1], rep[:-1], company[:-1], hub, hub_n, cell)
        rest = (cells[-1:], n[-1:], rep[-1:])
        if out is not None:
            yield out
    if rest is not None and len(rest[0]):
        out, *_ = _hubs(*rest, np.array([rest[0][0] == cell]), hub, hub_n, cell)
        if out is not None:
            yield out


def _hubs(cells, n, rep, company, hub, hub_n, cell):
    keep = np.flatnonzero(company)
    hubs = np.empty(len(keep), np.int64)
    if len(keep):
        c, m, r = cells[keep], n[keep], rep[keep]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        for lo, hi in zip(starts, np.append(starts[1:], len(c)), strict=True):
            go_on = c[lo] == cell and hub_n > 0
            i = lo
            while i < hi:
                if not (go_on and LINK_PERCENT * m[i] <= 100 * hub_n):
                    hub, hub_n = int(r[i]), int(m[i])
                j = lo + int(np.searchsorted(m[lo:hi], 100 * hub_n // LINK_PERCENT, "right"))
                hubs[i:j] = hub
                i, go_on = j, False
            cell = c[lo]
        out = batch(cell=pa.array(c), rep=pa.array(r), n=pa.array(m), hub=pa.array(hubs))
    else:
        out = None
    if len(cells):
        if cells[-1] != cell:
            cell, hub_n = cells[-1], -1
    return out, hub, hub_n, cell


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures allow a link."""
    for b in batches:
        keep = []
        for n1, s1, n2, s2 in zip(*(b.column(k).to_pylist() for k in ("na", "sa", "nb", "sb")), strict=True):
            x, y = np.frombuffer(s1, np.uint8), np.frombuffer(s2, np.uint8)
            width = 8 * min(len(x), len(y))
            keep.append(bool(may_link(n1, n2, int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()))))
        yield batch(a=b.column("a"), b=b.column("b")).filter(pa.array(keep, pa.bool_()))


def across(best: bool):
    """Pairs of a tile that lie in different components and whose signatures allow a link, all or for each set only its nearest; rows sorted by cell, i, j.
    A tile of two blocks compares only across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches, ["cell", "i", "j"], most=1 << 30):
            comp, n, rep, block = (t.column(k).to_numpy() for k in ("comp", "n", "rep", "block"))
            order = np.argsort(n, kind="stable")
            comp, n, rep, block = comp[order], n[order], rep[order], block[order]
            sigs = t.column("sig").to_pylist()
            sigs = [np.frombuffer(sigs[k], np.uint8) for k in order]
            widths = np.array([8 * len(s) for s in sigs])  # grows with n
            two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
            left, right = [], []
            least, nearest = np.full(len(n), 1 << 40), np.full(len(n), -1)
            for width in np.unique(widths):
                lo = int(np.searchsorted(widths, width))
                m = np.stack([folded(s, width) for s in sigs[lo : int(np.searchsorted(n, 100 * n[widths == width][-1] // LINK_PERCENT, "right"))]])
                m = m.view(U) if m.shape[1] >= 8 else m
                for k in range(lo, lo + int((widths == width).sum())):
                    hi = min(lo + len(m), int(np.searchsorted(n, 100 * n[k] // LINK_PERCENT, "right")))
                    other = k + 1 + np.flatnonzero(comp[k + 1 : hi] != comp[k])
                    if two:
                        other = other[block[other] != block[k]]
                    if not len(other):
                        continue
                    bits = np.bitwise_count(m[other - lo] ^ m[k - lo]).sum(axis=1, dtype=np.int64)
                    ok = may_link(n[k], n[other], bits)
                    if not ok.any():
                        continue
                    other, bits = other[ok], bits[ok]
                    if best:
                        nearer = bits < least[other]
                        least[other[nearer]], nearest[other[nearer]] = bits[nearer], k
                        i = int(np.argmin(bits))
                        if bits[i] < least[k]:
                            least[k], nearest[k] = bits[i], other[i]
                        continue
                    left.append(np.minimum(rep[other], rep[k]))
                    right.append(np.maximum(rep[other], rep[k]))
            own = np.flatnonzero(nearest >= 0)
            left.append(np.minimum(rep[own], rep[nearest[own]]))
            right.append(np.maximum(rep[own], rep[nearest[own]]))
            yield batch(a=pa.array(np.concatenate(left)), b=pa.array(np.concatenate(right)))

    return run


def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link by the intersection of their sorted arrays."""
    for b in batches:
        for lo, hi, data, at in text_blocks(b.column("ta")):
            part = b.slice(lo, hi - lo)
            sets, keep = shingle_sets(data, at), []
            for l2, h2, d2, a2 in text_blocks(part.column("tb")):
                for x, y in zip(sets[l2:h2], shingle_sets(d2, a2), strict=True):
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * i >= LINK_PERCENT * (len(x) + len(y) - i) and i > 0)
            yield batch(a=part.column("a"), b=part.column("b")).filter(pa.array(keep, pa.bool_()))


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    text = lambda side: docs.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long").distinct()


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) after further links (a, b)."""
    to = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    then = components(links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    every = comps.unionByName(then.join(comps, "node", "left_anti")).select("node", F.col("comp").alias("mid"))
    return every.join(then.select(F.col("node").alias("mid"), "comp"), "mid", "left").select("node", F.coalesce("comp", "mid").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    ours: list[DataFrame] = []
    with collecting(ours):
        out = saved(_near_duplicates(docs.select("doc_id", "text")), "near")
    dropped(*ours[:-1])  # the last is the result
    return out


def _near_duplicates(docs: DataFrame) -> DataFrame:
    sets = saved(docs.mapInArrow(describe, "doc_id long, n_shingles long, d1 long, d2 long, cells array<long>, sig binary"), "sets")
    classes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("cells").alias("cells"), F.any_value("sig").alias("sig"))
    reps = saved(classes, "classes")
    tiles = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("cells").alias("cell"))
    met = saved(tiles.repartition("cell").sortWithinPartitions("cell", "n", "rep").mapInArrow(mates, "cell long, rep long, n long, hub long"), "mates")
    known = lambda side: reps.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sig").alias(f"s{side}"))

    # first step: against the hubs
    counted = met.where("rep <> hub").groupBy("rep", "hub").count()
    hubs = counted.groupBy("rep").agg(F.min("hub").alias("h1"), F.max_by("hub", F.struct("count", -F.col("hub"))).alias("h2"))
    stars = hubs.select(F.col("rep").alias("b"), F.explode(F.array_distinct(F.array("h1", "h2"))).alias("a"))
    stars = saved(stars.join(known("a"), "a").join(known("b"), "b").mapInArrow(bounded, "a long, b long"), "stars")
    first = components(saved(linked(stars, docs), "links"))
    dropped(stars)

    # second step: what is left between components; each set's nearest until that joins nothing more, then all
    merged, best, done = first, True, False
    while not done:
        at = met.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("cell", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
        live = at.groupBy("cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("x < y")
        rows = at.join(live.select("cell", "blocks"), "cell").join(reps.select("rep", "sig"), "rep")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("cell", "rep", "n", "comp", "sig", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
        pairs = saved(rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(across(best), "a long, b long").distinct(), "pairs")
        more = saved(linked(pairs, docs), "links")
        dropped(pairs)
        if more.isEmpty():
            done, best = not best, False
            continue
        merged = saved(joined(merged, more), "merged")
        done = not best
    dropped(met)

    named = reps.select("n_shingles", "d1", "d2", "rep").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "d1", "d2", F.coalesce("comp", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i : i + 4], ' ') ELSE concat('#', array_to_string(ws, ' ')) END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
