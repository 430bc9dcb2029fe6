"""Keyword search over blocks of postings.

A block holds a thousand or so documents of one task, in order of their ids: for each asked term the places of the documents that have it, their weighted counts, and what a document of the block can
score for it at most. Blocks are written once, a row each, and read by the search as they lie: nothing is shuffled. In a block, a query whose terms are not all there is passed over, and so is one whose
bounds add up to less than the k-th score that the task has found so far; else the documents of its rarest term are intersected with those of the others, and what is left is scored.

Query sets of any size are taken in blocks of a bounded number of (query, term) pairs, whose terms are what a task looks for."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import forget, written

DOCS, PAIRS = 1024, 1 << 16
# Weights of the two fields of a document
TITLE, BODY = 1.0, 0.4
WORD = re.compile("[a-z0-9]+")


def posting_blocks(docs: DataFrame, id_: str, fields: Mapping[str, float], terms: list[str], size: int = DOCS) -> DataFrame:
    """A row a block: its ids and lengths in words, and for each of `terms` that it has, the places and weighted counts (one list after another, by ends), the greatest count and the least length. fields:
    text columns and their weights. n and total: documents with a word, and their words. Documents without a word are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    weights = list(fields.values())

    def block(number: dict[str, int], ids: list, texts: list[tuple]) -> dict:
        kept, lengths, found = [], [], {}
        for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k])):
            words, length = {}, 0
            for weight, text in zip(weights, texts[k], strict=True):
                counts = Counter(WORD.findall(text or ""))
                length += sum(counts.values())
                for w in counts.keys() & number.keys():
                    words[w] = words.get(w, 0.0) + weight * counts[w]
            if length:
                for w, n in words.items():
                    found.setdefault(number[w], []).append((len(kept), n))
                kept.append(ids[k])
                lengths.append(length)
        order = sorted(found)
        flat = [x for t in order for x in found[t]]
        return {
            "ids": kept, "lengths": lengths, "n": len(kept), "total": sum(lengths), "terms": order, "ends": list(np.cumsum([len(found[t]) for t in order])), "places": [p for p, _ in flat], "counts": [float(c) for _, c in flat],
            "greatest": [max(c for _, c in found[t]) for t in order], "least": [min(lengths[p] for p, _ in found[t]) for t in order],
        }

    kind = docs.schema[id_].dataType.simpleString()
    out = f"ids array<{kind}>, lengths array<long>, n long, total long, terms array<int>, ends array<long>, places array<int>, counts array<double>, greatest array<double>, least array<long>"
    ids_type, order = to_arrow_type(docs.schema[id_].dataType), [part.split()[0] for part in out.split(", ")]
    lists = {"lengths": pa.int64(), "ends": pa.int64(), "terms": pa.int32(), "places": pa.int32(), "counts": pa.float64(), "greatest": pa.float64(), "least": pa.int64(), "ids": ids_type}
    schema = pa.schema([(c, pa.list_(lists[c]) if c in lists else pa.int64()) for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                one = block(number, part.column("id").to_pylist(), list(zip(*(part.column(f"f{i}").to_pylist() for i in range(len(weights))), strict=True)))
                yield pa.RecordBatch.from_pylist([one], schema=schema)

    return docs.select(F.col(id_).alias("id"), *[F.lower(c).alias(f"f{i}") for i, c in enumerate(fields)]).mapInArrow(run, out)


def add_counts(total: np.ndarray, blocks: pa.RecordBatch) -> None:
    """Adds the documents of each term of some blocks, which are taken as they lie in the batch: as numbers of Python all blocks of a task would take several times their memory."""
    for terms, ends in zip(blocks.column("terms"), blocks.column("ends"), strict=True):
        total[terms.values.to_numpy()] += np.diff(ends.values.to_numpy(), prepend=0)


def document_counts(blocks: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            add_counts(total, b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in blocks.select("terms", "ends").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def top_of_blocks(blocks: DataFrame, asked: list[list[int]], idf: np.ndarray, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """query (its number), id, score of each task's k best documents that have all terms of the query."""
    shared = blocks.sparkSession.sparkContext.broadcast((asked, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = shared.value
        # queries by their rarest term, so that a block looks only at those it can answer
        by_rarest: dict[int, list[int]] = {}
        for q, terms in enumerate(asked):
            by_rarest.setdefault(max(terms, key=lambda t: (idf[t], t)), []).append(q)
        best: dict[int, list[tuple]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row].values.to_numpy()  # noqa: B023, E731
                terms, ends, places, counts = (value(c) for c in ("terms", "ends", "places", "counts"))
                if not len(terms):
                    continue
                shape = k1 * (1 - b + b * value("lengths") / mean)
                at = {int(t): i for i, t in enumerate(terms)}
                starts = np.concatenate([[0], ends[:-1]])
                most = idf[terms] * value("greatest") * (k1 + 1) / (value("greatest") + k1 * (1 - b + b * value("least") / mean))
                ids = None
                for q in (q for t in at for q in by_rarest.get(t, ())):
                    own = asked[q]
                    if not all(t in at for t in own):
                        continue
                    held = best.setdefault(q, [])
                    if len(held) == k and round(float(sum(most[at[t]] for t in own)), 6) < -held[-1][0]:
                        continue
                    spans = sorted(((int(starts[at[t]]), int(ends[at[t]]), idf[t]) for t in own), key=lambda s: s[1] - s[0])
                    left = places[spans[0][0] : spans[0][1]]
                    for lo, hi, _ in spans[1:]:
                        left = left[np.isin(left, places[lo:hi], assume_unique=True)]
                        if not len(left):
                            break
                    if not len(left):
                        continue
                    score = np.zeros(len(left))
                    for lo, hi, weight in spans:
                        tf = counts[lo:hi][np.searchsorted(places[lo:hi], left)]
                        score += weight * tf * (k1 + 1) / (tf + shape[left])
                    ids = batch.column("ids")[row].values.to_pylist() if ids is None else ids
                    held += [(-round(float(s), 6), ids[p] is None, ids[p]) for s, p in zip(score, left, strict=True)]
                    held.sort()
                    del held[k:]
        rows = [(q, x[2], -x[0]) for q, held in best.items() for x in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], names=["query", "id", "score"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.select("ids", "lengths", "terms", "ends", "places", "counts", "greatest", "least").mapInArrow(run, f"query int, id {kind}, score double")


def block_search(queries: DataFrame, docs: DataFrame, fields: Mapping[str, float], k: int, id_: str = "doc_id", k1: float = 1.2, b: float = 0.75, most: int = PAIRS, size: int = DOCS) -> DataFrame:
    """query_id, id, score, rank: for each of queries (query_id, query) the k documents with all of its words that score best, by BM25 over counts weighted by field. A query without words has no rows."""
    spark = docs.sparkSession
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))
    pairs, place = written(queries.select("query_id", F.explode(words).alias("term")).distinct(), "asked")
    blocks_of_queries = max(1, -(-pairs.count() // most))
    out = None
    for i in range(blocks_of_queries):
        own = pairs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks_of_queries)) == i).orderBy("query_id", "term").collect()  # about `most` pairs
        if not own:
            continue
        terms, ids = sorted({r.term for r in own}), list(dict.fromkeys(r.query_id for r in own))
        number, at = {t: n for n, t in enumerate(terms)}, {q: n for n, q in enumerate(ids)}
        asked: list[list[int]] = [[] for _ in ids]
        for r in own:
            asked[at[r.query_id]].append(number[r.term])
        blocks, where = written(posting_blocks(docs, id_, fields, terms, size), "postings")
        all_ = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        df = document_counts(blocks, len(terms))
        idf = np.array([math.log(1 + (all_.n - x + 0.5) / (x + 0.5)) for x in df])
        found = top_of_blocks(blocks, asked, idf, all_.total / max(all_.n, 1), k, k1, b)
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}")
        w = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        one, _ = written(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(names, "query").select("query_id", F.col("id").alias(id_), "score", "rank"), "ranked")
        forget(spark, where)
        out = one if out is None else out.unionByName(one)
    forget(spark, place)
    if out is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {id_} {docs.schema[id_].dataType.simpleString()}, score double, rank int")
    return out
