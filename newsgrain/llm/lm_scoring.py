"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER long with the counts of the bytes that follow (and of the end). A byte is predicted in its longest context; a byte not seen there
escapes to the next shorter one with probability distinct / (2 * total) (and a byte seen n times has (2 n - 1) / (2 * total)), where the bytes of the longer context no longer count (symbol exclusion), down to
equal shares for what is left. The score is the log10 probability of the text with A-Z lower-cased, and of its end.

All training texts are counted: each task counts its (context, byte) grams, and Spark adds them up. The trie goes to the tasks in pieces of about MOST grams, dealt by the last two bytes
of the context; one pass over the texts scores the positions of each piece, and the passes add up to the same score. Pieces go one after another: the driver fetches one, its pass is written to the
shared folder, and it is given up before the next is fetched, so neither driver nor task holds more than a piece. The number of passes grows with the trie. Word counts for the base score are
added up over all training texts too; the HEAD most frequent words go to the tasks, the others are joined.

Null texts count as empty: one token, the end. Very long texts are scored whole. A null doc_id counts as the empty text for the held-out rule. Repeated rows are scored each for itself, and equal texts
alike; words of equal counts at the edge of HEAD change nothing but the way they are looked up. Other columns, of any name, are not read. Without training texts
every count is 0 and the model gives equal shares. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import M1, U, as_long, batch, lists, text_blocks, word_hashes
from .common import saved, table

ORDER, BITS, END, START = 5, 9, 256, 257
MOST, HEAD = 2_500_000, 1 << 17
FOLD = np.arange(256)
FOLD[65:91] += 32
WORD_END = np.array([0x5E0F_E11D], U)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER symbols of context and the next, packed, for each byte and each end; and the n + 1 offsets of each text's."""
    n, size = len(at) - 1, np.diff(at)
    wide = np.full(len(data) + n * (ORDER + 1), END, np.int64)
    first = at[:-1] + np.arange(n) * (ORDER + 1) + ORDER
    for k in range(1, ORDER + 1):
        wide[first - k] = START
    wide[np.arange(len(data)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, size)] = FOLD[data]
    packed = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        packed += wide[ORDER - k : len(wide) - k] << (BITS * k)
    keep = np.ones(len(packed), bool)
    for k in range(1, ORDER + 1):
        keep[(first - k - ORDER)[first - k >= ORDER]] = False
    return packed[keep], at + np.arange(n + 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def counted(values_of):
    """Batches of (doc_id, text) -> (key, n), added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for b in batches:
            for _, _, data, at in text_blocks(b.column("text"), 1 << 19):
                parts.append(np.unique(values_of(data, at), return_counts=True))
                if sum(len(k) for k, _ in parts) > 1_200_000:
                    parts = [_summed(parts)]
                    if len(parts[0][0]) > 800_000:
                        yield batch(key=as_long(parts[0][0]), n=as_long(parts[0][1]))
                        parts = []
        if parts:
            k, n = _summed(parts)
            yield batch(key=as_long(k), n=as_long(n))

    return run


def gram_values(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return grams(data, at)[0]


def word_values(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([word_hashes(data, at, lower=True)[0], np.repeat(WORD_END, len(at) - 1)])


class Trie:
    """Counts of (context, symbol) for each order, as sorted arrays."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: np.ndarray, low_n: np.ndarray) -> None:
        """keys: full grams of this piece; low: all grams of one byte of context."""
        self.orders = []
        for k in range(ORDER + 1):
            src, m = (low, low_n) if k < 2 else (keys, n)
            self.orders.append(_summed([(src & ((1 << BITS * (k + 1)) - 1), m)]) if len(src) else (np.empty(0, np.int64), np.empty(0, np.int64)))
        keys, n = self.orders[-1]
        context = keys >> BITS
        starts = np.flatnonzero(np.diff(context, prepend=-1))
        total = np.add.reduceat(n, starts) if len(keys) else n
        distinct = np.diff(starts, append=len(keys))
        self.keys, self.value = keys, np.log10((2 * n - 1) / np.repeat(2 * total, distinct))
        self.bits = max(8, int(2 * len(keys) + 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.slot[self._place(keys)] = np.arange(len(keys))
        self.memo: dict[int, float] = {}

    def _place(self, g: np.ndarray) -> np.ndarray:
        return ((g.view(U) * M1) >> U(64 - self.bits)).astype(np.int64)

    def log10(self, g: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.array([self.escaped(int(x)) for x in g])
        at = self.slot[self._place(g)]
        out = self.value[at]
        miss = np.flatnonzero((at < 0) | (self.keys[at] != g))
        if len(miss):
            new, where = np.unique(g[miss], return_inverse=True)
            k = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
            found = self.keys[k] == new
            v = self.value[k]
            for i in np.flatnonzero(~found):
                v[i] = self.escaped(int(new[i]))
            out[miss] = v[where]
        return out

    def escaped(self, g: int) -> float:
        if (v := self.memo.get(g)) is not None:
            return v
        symbol, out, gone = g & ((1 << BITS) - 1), 0.0, set()
        for k in range(ORDER, -1, -1):
            keys, n = self.orders[k]
            context = (g >> BITS) & ((1 << BITS * k) - 1)
            a, b = np.searchsorted(keys, [context << BITS, (context + 1) << BITS])
            here = {int(s) & ((1 << BITS) - 1): int(m) for s, m in zip(keys[a:b], n[a:b], strict=True)}
            here = {s: m for s, m in here.items() if s not in gone}
            if not here:
                continue
            total = 2 * sum(here.values())
            if symbol in here:
                out += math.log10((2 * here[symbol] - 1) / total)
                break
            out += math.log10(len(here) / total)
            gone |= here.keys()
        else:
            out -= math.log10(max(1, END + 1 - len(gone)))
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[g] = out
        return out


def piece(g, pieces: int):
    """Which piece of the trie a gram (array or column) belongs to, by the last two symbols of its context; no step leaves 64 bits."""
    column = isinstance(g, Column)
    spread = ((F.shiftright(g, BITS) if column else g >> BITS) % (1 << 2 * BITS)) * 2654435761
    return (F.shiftright(spread, 16) if column else spread >> 16) % pieces


def trie_scores(trie: Trie, data: np.ndarray, at: np.ndarray, k: int, pieces: int) -> np.ndarray:
    """log10 probability of each text's positions that piece k predicts."""
    out = []
    for lo in range(0, len(at) - 1, 256):
        part = at[lo : lo + 257]
        g, off = grams(data[part[0] : part[-1]], part - part[0])
        if pieces == 1:
            v = trie.log10(g)
        else:
            own = np.flatnonzero(piece(g, pieces) == k)
            v = np.zeros(len(g))
            v[own] = trie.log10(g[own])
        out.append(np.add.reduceat(v, off[:-1]))
    return np.concatenate(out)


def piece_scores(docs: DataFrame, shared, k: int, pieces: int) -> DataFrame:
    """at, score of the positions of piece k, for docs (at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*shared.value)
        for b in batches:
            for lo, hi, data, at in text_blocks(b.column("text"), 1 << 19):
                yield batch(at=b.column("at").slice(lo, hi - lo), score=pa.array(trie_scores(trie, data, at, k, pieces)))

    return docs.select("at", "text").mapInArrow(run, "at long, score double")


def first_pass(docs: DataFrame, frequent, shared, pieces: int) -> DataFrame:
    """The columns of docs but text; n_tokens; known words and the sum of log10(c + 1) over frequent words; the other words and how often each comes; the score by the first piece of the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = frequent.value
        trie, logs = Trie(*shared.value), np.append(np.log10(n + 1.0), 0.0)
        for b in batches:
            for lo, hi, data, at in text_blocks(b.column("text"), 1 << 19):
                words, _, wo = word_hashes(data, at, lower=True)
                i = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
                hit = keys[i] == words if len(keys) else np.zeros(len(words), bool)
                spans = list(zip(wo[:-1], wo[1:], strict=True))
                rest = [np.unique(words[a:e][~hit[a:e]], return_counts=True) for a, e in spans]
                hits = np.concatenate([[0], np.cumsum(hit)])
                yield batch(
                    **{c: b.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out", "at")},
                    n_tokens=pa.array(np.diff(wo) + 1, pa.int64()),
                    known=pa.array(hits[wo[1:]] - hits[wo[:-1]], pa.int64()),
                    logs=pa.array([float(logs[i[a:e]][hit[a:e]].sum()) for a, e in spans]),
                    words=lists([x for x, _ in rest]),
                    times=lists([x for _, x in rest]),
                    score=pa.array(trie_scores(trie, data, at, 0, pieces)),
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "at", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, at long, n_tokens long, known long, logs double, words array<long>, times array<long>, score double")


def lm_scores(docs: DataFrame, held_out, most: int = MOST, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text); held_out: a boolean column."""
    spark = docs.sparkSession
    d = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = d.where("NOT held_out").select("doc_id", "text")

    trie = saved(train.mapInArrow(counted(gram_values), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "trie")
    counts = saved(train.mapInArrow(counted(word_values), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    arrays = lambda df: tuple(df.toArrow().column(c).to_numpy() for c in ("key", "n"))
    low = arrays(trie.groupBy(F.col("key").bitwiseAND((1 << 2 * BITS) - 1).alias("key")).agg(F.sum("n").alias("n")))  # at most 258 * 257 rows
    pieces = max(1, -(-trie.count() // most))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("key") == int(WORD_END.view(np.int64)[0]), F.col("n"))), F.lit(0)).alias("ends")).first()

    numbered = d.withColumn("at", F.monotonically_increasing_id())
    frequent = counts.where(F.col("key") != int(WORD_END.view(np.int64)[0])).orderBy(F.desc("n"), "key").limit(head)
    keys, n = arrays(frequent)
    order = np.argsort(keys.view(U))
    send = lambda *x: spark.sparkContext.broadcast(x)
    of = lambda k: arrays(trie if pieces == 1 else trie.where(piece(F.col("key"), pieces) == k))
    head_words, piece_0 = send(keys.view(U)[order], n[order]), send(*of(0), *low)
    rows = saved(first_pass(numbered, head_words, piece_0, pieces), "scored")
    head_words.destroy()
    piece_0.destroy()

    def scored(k: int) -> DataFrame:
        shared = send(*of(k), *low)
        out = saved(piece_scores(numbered, shared, k, pieces), "piece")
        shared.destroy()
        return out

    rest = rows.select("at", F.explode(F.arrays_zip("words", "times")).alias("w")).select(F.col("at").alias("_at"), F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    rest = rest.join(counts, "key").groupBy("_at").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    out = rows.drop("words", "times").join(rest, F.col("at") == F.col("_at"), "left")
    if pieces > 1:
        others = [scored(k) for k in range(1, pieces)]
        others = reduce(DataFrame.unionByName, others).groupBy(F.col("at").alias("_b")).agg(F.sum("score").alias("others"))
        out = out.join(others, F.col("at") == F.col("_b")).withColumn("score", F.col("score") + F.col("others"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(math.log10(total.ends + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(total.ends > 0))).cast("long").alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(total.n + total.v + 1)).alias("base_score"),
        "score",
    )


def held_out_rule() -> F.col:
    """crc32 of doc_id as text, mod 7, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir), held_out_rule())
