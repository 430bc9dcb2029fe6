"""Ranked lexical search with bag deduplication.

Only the terms of the items can score, so a document is reduced to its bag: the counts of those terms, and m, which stands for its length. Documents with the same bag and the same m score alike
for every item. They form a class, found by a hash of both and told apart by the bag itself; of each class the `k` documents with the least doc_id are kept, since no item can rank another one.
Each class is scored once, and the classes that an item ranks are expanded by ascending doc_id.

Items are taken in blocks of a bounded number of (item, term) pairs, which are what a task holds; for a larger query set the documents are read once for each block. A class of any size is cut to k
rows in every task before it is shuffled. Sums are exact in 64 bits.

Terms are those of the whole text, however long. Null texts, and those without a term, are in no count and are never ranked. Rows that repeat a doc_id are documents of their own; a null doc_id comes
after all others. Items that repeat an item_id are one item with the terms of all; a null item_id is an item as well. An item without a term, or whose terms no document has, has no rows. Equal
scores are ranked by ascending doc_id. Other columns, of any name, are not read. An empty table on either side gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import LOWER, NOT_TERM, U, batch, text_blocks, utf8, word_hashes, word_sizes
from .common import dropped, saved, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PAIRS = 1 << 16
_LARGEST = (1 << 63) - 1


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its terms once."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def dealt(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs with the block of their item: items in the order of their hash, as many a block as together have about `most` pairs. An item of more is a block of its own."""
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n"))
    if not sizes.agg((F.sum("n") > most).alias("more")).first().more:
        return pairs.withColumn("block", F.lit(0))
    # counts by hash range first, so that the running total needs no single task for all items
    sizes = sizes.withColumn("h", F.xxhash64("item_id")).withColumn("range", F.shiftright("h", 52))
    before = sizes.groupBy("range").agg(F.sum("n").alias("all"))
    before = before.select("range", (F.sum("all").over(W.orderBy("range")) - F.col("all")).alias("before"))  # 4,096 rows at most
    upto = F.col("before") + F.sum("n").over(W.partitionBy("range").orderBy("h", "item_id")) - F.col("n")
    blocks = sizes.join(before, "range").select("item_id", F.floor(upto / most).cast("int").alias("block"))
    return pairs.alias("p").join(blocks.alias("b"), F.col("p.item_id").eqNullSafe(F.col("b.item_id"))).select("p.item_id", "term", "block")


class Vocabulary:
    """Terms in order, found by hash and compared byte for byte."""

    def __init__(self, words: list[str]) -> None:
        self.data, at = utf8(pa.array(words, pa.large_string()))
        self.start, self.size = at[:-1], np.diff(at)
        hashes = word_hashes(self.data, at, gap=np.zeros(256, bool))[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of a block of items share a 64-bit hash")

    def places(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word that is a term, else -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.where(self.hashes[at] == hashes, self.order[at], -1)
        near = np.flatnonzero(place >= 0)
        near, other = near[size[near] == self.size[place[near]]], near[size[near] != self.size[place[near]]]
        place[other] = -1
        n = size[near]
        word = np.repeat(np.arange(len(near)), n)
        step = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        wrong = LOWER[data[starts[near][word] + step]] != self.data[self.start[place[near]][word] + step]
        place[near[word[wrong]]] = -1
        return place


def bags(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats) and bag (term, count, term, count, ... by ascending term) of each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most as many as a block has pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        for b in batches:
            for lo, hi, data, at in text_blocks(b.column("text")):
                hashes, starts, to = word_hashes(data, at, lower=True, gap=NOT_TERM)
                distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                place = known.places(data, distinct, starts[first], word_sizes(data, starts, NOT_TERM)[first])[which]
                held, n = place >= 0, np.diff(to)
                pairs, tf = np.unique(np.repeat(np.arange(hi - lo), n)[held] * len(words) + place[held], return_counts=True)
                doc = pairs // len(words)
                flat = np.stack([pairs % len(words), tf], axis=1).astype(np.int32).ravel()
                bag = pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), pa.array(flat))
                out = batch(doc_id=b.column("doc_id").slice(lo, hi - lo), n=pa.array(n, pa.int64()), bag=bag)
                yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, bag array<int>")


def flat_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of a batch of bags."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy()[at[0] : at[-1]]
    return np.repeat(np.arange(len(column)), np.diff(at) // 2), values[::2], values[1::2].astype(np.int64)


def document_counts(found: DataFrame, n_words: int) -> dict[int, int]:
    """df of each term that a document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words, np.int64)
        for b in batches:
            total += np.bincount(flat_bags(b.column("bag"))[1], minlength=n_words)
        term = np.flatnonzero(total)
        yield batch(term=pa.array(term, pa.int32()), df=pa.array(total[term]))

    return {r.term: r.df for r in found.select("bag").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def best(item: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each item; equal ones by ascending `first`."""
    order = np.lexsort((first, -score, item))
    item = item[order]
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, np.int64)
    return order[np.arange(len(item)) - np.repeat(start, np.diff(start, append=len(item))) < k]


def scored(classes: DataFrame, weight: np.ndarray, holders: list[list[int]], k: int) -> DataFrame:
    """item (its number), score, first and docs of each task's k best classes of each item. holders: the items of each term."""
    shared = classes.sparkSession.sparkContext.broadcast((weight, np.concatenate([[0], np.cumsum([len(x) for x in holders])]), np.array([i for x in holders for i in x], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, at, items = shared.value
        n_items = int(items.max()) + 1
        kept = None
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                b = big.slice(lo, 2048)
                row, term, tf = flat_bags(b.column("bag"))
                m, first = b.column("m").to_numpy(), b.column("first").to_numpy()
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                n = np.diff(at)[term]
                entry = np.repeat(np.arange(len(term)), n)
                item = items[np.repeat(at[term], n) + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)]
                cell, value = row[entry] * n_items + item, value[entry]
                # halves of 30 bits add up exactly in doubles
                low, high = (np.bincount(cell, x, b.num_rows * n_items) for x in (value & (1 << 30) - 1, value >> 30))
                score = (high.astype(np.int64) << 30) + low.astype(np.int64)
                cell = np.flatnonzero(score > 0)
                row, item, score = cell // n_items, cell % n_items, score[cell]
                top = best(item, score, first[row], k)
                new = batch(item=pa.array(item[top], pa.int32()), score=pa.array(score[top]), first=pa.array(first[row[top]]), docs=b.column("docs").take(pa.array(row[top])))
                kept = pa.Table.from_batches([new]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([new])])
                kept = kept.take(pa.array(best(*(kept.column(c).to_numpy() for c in ("item", "score", "first")), k)))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    docs = classes.schema["docs"].dataType.simpleString()
    return classes.select("bag", "m", "first", "docs").mapInArrow(run, f"item int, score long, first long, docs {docs}")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs (doc_id, text) for each of items (item_id, text)."""
    spark = docs.sparkSession
    pairs = saved(dealt(item_terms(items), most), "item-terms")
    out = None
    for block in sorted(r.block for r in pairs.select("block").distinct().collect()):
        own = pairs.where(F.col("block") == block).orderBy("item_id", "term").select("item_id", "term").collect()  # at most `most`, or one item's
        words, ids = sorted({r.term for r in own}), list(dict.fromkeys(r.item_id for r in own))
        number, at = {x: i for i, x in enumerate(ids)}, {w: i for i, w in enumerate(words)}
        holders: list[list[int]] = [[] for _ in words]
        for r in own:
            holders[at[r.term]].append(number[r.item_id])
        found = saved(bags(docs, words), "bags")
        total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        df = document_counts(found, len(words))
        weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)
        m = F.expr(f"100 - 90 + (90 * n * {total.docs}L) div {total.terms or 1}L")
        last = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LARGEST))
        same = ["hash", "m", "bag"]
        rows = found.where("size(bag) > 0").select("doc_id", m.alias("m"), "bag").withColumns({"hash": F.xxhash64("m", "bag"), "last": last})
        rows = rows.withColumn("r", F.row_number().over(W.partitionBy(*same).orderBy("last"))).where(F.col("r") <= k)
        classes = saved(rows.groupBy(*same).agg(F.min("last").alias("first"), F.sort_array(F.collect_list(F.struct("last", "doc_id"))).alias("docs")), "classes")  # k entries each
        top = scored(classes, weight, holders, k)
        top = top.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k)
        each = top.select("item", "score", F.explode("docs").alias("d")).select("item", "score", "d.last", "d.doc_id")
        ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "last"))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        one = saved(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        dropped(found, classes)
        out = one if out is None else out.unionByName(one)
    dropped(pairs)
    if out is None:
        kinds = [x.schema[c].dataType.simpleString() for x, c in ((items, "item_id"), (docs, "doc_id"))]
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return out


#: The same in DuckDB.
OP11_SQL = """WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS row, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (row), c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s JOIN d USING (row) WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))
