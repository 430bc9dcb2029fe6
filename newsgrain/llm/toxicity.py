"""Toxicity by class-conditional Kneser-Ney models.

A term (letters and digits; A-Z folded) is a sequence of bytes between two blanks. Two models, of toxic and of ordinary documents, give each byte's probability after the up to five bytes before it:
counts of the own class, discounted, and for the rest a distribution over shorter contexts that rests on how many different contexts a byte string follows, counted over both classes together.
So an expression that neither class has seen, or a rare one, is judged by shared counts and speaks for neither. A toxic document is not toxic in each term: a term of it comes from the toxic
model with probability `share`, else from the ordinary one. The two log-likelihoods of a document are divided by its number of terms and compared; a logistic curve turns the difference into a score.
The curve is fitted on differences that a model of one half of the sample gives the other half.

The sample is, of each class, the labelled rows with the least hash of doc_id, at most `rows` rows and `size` bytes of text (parameters); rows whose crc32 leaves 2 modulo 4 never enter it. Scores
cover all rows and whole texts, however long.

Null and empty texts, and those without a term, have difference 0. Rows with a null doc_id are scored and not held out. A doc_id labelled twice is toxic if one label says so; null labels are left out.
Of training rows that repeat a doc_id the least text counts, and equal texts count once; in the result each row stands for itself, and equal texts get equal scores. A score equal to `least` counts
as toxic. If only one class is labelled all scores are 0 or 1 accordingly, without any label 0. Other columns, of any name, are not read. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import LOWER, NOT_TERM, U, as_long, batch, text_blocks, word_hashes, word_sizes
from .common import dropped, saved, table

ORDER = 6
ROWS, SIZE, SHARE, LEAST = 4096, 32 << 20, 0.005, 0.3
_BYTE = U(8)


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: the distinct terms' counts, the distinct term of each term, offsets of each text's terms, and every distinct term's byte strings (see grams) with the term they are of."""
    hashes, starts, to = word_hashes(data, at, lower=True, gap=NOT_TERM)
    size = word_sizes(data, starts, NOT_TERM)
    _, first, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return n, which, to, *grams(data, starts[first], size[first])


def grams(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each term, and the blank after it: up to ORDER bytes that end there as one number, from the blank before the term on; and the term."""
    n = size + 2
    at = np.concatenate([[0], np.cumsum(n)])
    term = np.repeat(np.arange(len(size)), n)
    place = np.arange(at[-1]) - at[term]
    within = (place > 0) & (place <= size[term])
    text = np.full(at[-1], 32, np.uint8)
    text[within] = LOWER[data[(starts[term] + place - 1)[within]]]
    key = np.zeros(at[-1], U)
    for d in range(ORDER):
        back = np.zeros(at[-1], U)
        back[d:] = text[: max(at[-1] - d, 0)].astype(U) << U(8 * d)
        key |= np.where(place >= d, back, U(0))
    return key[place > 0], term[place > 0]


def lengths(keys: np.ndarray) -> np.ndarray:
    return sum((keys >> U(8 * d) > 0).astype(np.int64) for d in range(ORDER))


def ending(keys: np.ndarray, n) -> np.ndarray:
    """The last n bytes."""
    return keys & ((U(1) << (_BYTE * np.asarray(n).astype(U))) - U(1))


def discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def at_keys(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in known (sorted), and whether they do."""
    where = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return where, known[where] == keys if len(known) else np.zeros(len(keys), bool)


def shared_backoff(keys: np.ndarray) -> np.ndarray:
    """For each gram, the probability of its last byte after its context less the first byte, from the number of different bytes that come before byte strings in either class."""
    level, seen = np.unique(keys), {}
    for _ in range(ORDER):
        n = lengths(level)
        for size in np.unique(n):
            seen.setdefault(int(size), []).append(level[n == size])
        level = np.unique(ending(level[n > 1], n[n > 1] - 1))
    below, out, size_of = None, np.full(len(keys), 1 / 257), lengths(keys)
    for size in range(1, ORDER):
        if size + 1 not in seen:
            break
        own, n = np.unique(ending(np.unique(np.concatenate(seen[size + 1])), size), return_counts=True)
        _, context = np.unique(own >> _BYTE, return_inverse=True)
        total, kinds, off = np.bincount(context, n), np.bincount(context), discount(n)
        base = 1 / 257 if below is None else below[1][at_keys(below[0], ending(own, size - 1))[0]]
        below = own, (np.maximum(n - off, 0) + off * kinds[context] * base) / total[context]
        of = size_of == size + 1
        out[of] = below[1][at_keys(own, ending(keys[of], size))[0]]
    return out


def ratios(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log of toxic over ordinary probability: of each gram that a class has seen, and of any other gram after each context (there the shared distribution cancels).
    keys: sorted grams; counts: of ordinary and toxic documents."""
    base = shared_backoff(keys)
    contexts, context = np.unique(keys >> _BYTE, return_inverse=True)
    p, rest = np.empty((len(keys), 2)), np.empty((len(contexts), 2))
    for k in range(2):
        n, off = counts[:, k], discount(counts[:, k])
        total, kinds = np.bincount(context, n, len(contexts)), np.bincount(context, n > 0, len(contexts))
        rest[:, k] = np.where(total > 0, off * kinds / np.maximum(total, 1), 1)
        p[:, k] = np.maximum(n - off, 0) / np.maximum(total[context], 1) + rest[context, k] * base
    log = lambda x: np.log(x[:, 1] / x[:, 0]).astype(np.float32)
    return keys, log(p), contexts, log(rest)


def differences(model: tuple, share: float, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text as a toxic one less that as an ordinary one, divided by its number of terms."""
    keys, seen, contexts, unseen = model
    n, which, to, found, term = terms(data, at)
    where, hit = at_keys(keys, found)
    rest, known = at_keys(contexts, found >> _BYTE)
    ratio = np.bincount(term, np.where(hit, seen[where], np.where(known, unseen[rest], 0)), len(n))
    x = np.log1p(share * np.expm1(np.minimum(ratio, 80)))[which]
    total = np.concatenate([[0], np.cumsum(x)])
    return (total[to[1:]] - total[to[:-1]]) / np.maximum(np.diff(to), 1)


def logistic(x: np.ndarray, label: np.ndarray, heavy: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton's steps, with a small ridge."""
    rows, b = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ b, -30, 30)))
        step = np.linalg.solve((rows * (heavy * p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(2), rows.T @ (heavy * (label - p)) - 0.01 * b)
        b += step * min(1, 20 / max(np.abs(step).max(), 1e-12))
    return float(b[0]), float(b[1])


def sampled(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> tuple[DataFrame, dict[int, int]]:
    """text, toxic, fold of the sample, and the number of labelled documents of each class that may be learnt from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # 2 * rows numbers at most
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = found.groupBy("text").agg(F.max("toxic").alias("toxic"))
    upto = F.sum(F.octet_length("text")).over(W.partitionBy("toxic").orderBy(F.xxhash64("text"), "text"))
    return saved(found.withColumn("upto", upto).where(F.col("upto") <= size).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")), "toxic-sample"), counts


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a part of the sample and their counts by class and fold."""
    for b in batches:
        cell = 2 * b.column("toxic").to_numpy() + b.column("fold").to_numpy()
        for lo, hi, data, at in text_blocks(b.column("text")):
            n, which, to, keys, term = terms(data, at)
            each = np.bincount(4 * which + np.repeat(cell[lo:hi], np.diff(to)), minlength=4 * len(n)).reshape(-1, 4)
            own, where = np.unique(keys, return_inverse=True)
            yield batch(gram=as_long(own), **{f"n{k}": pa.array(np.bincount(where, each[term, k], len(own)).astype(np.int64)) for k in range(4)})


def fitted(sample: DataFrame, counts: dict[int, int], share: float) -> tuple[tuple, float, float] | None:
    """The model of the whole sample with the curve's slope and intercept; None without texts of both classes."""
    cells = [f"n{k}" for k in range(4)]
    rows = sample.mapInArrow(counted, "gram long, " + ", ".join(f"{c} long" for c in cells)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in cells]).toArrow()  # bounded by the sample
    keys, n = rows.column("gram").to_numpy().astype(U), np.stack([rows.column(c).to_numpy() for c in cells], axis=1).astype(float)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    if not (n[:, :2].any() and n[:, 2:].any()):
        return None

    def model(*folds: int) -> tuple:
        own = n[:, list(folds)].sum(axis=1), n[:, [2 + k for k in folds]].sum(axis=1)
        held = own[0] + own[1] > 0
        return ratios(keys[held], np.stack(own, axis=1)[held])

    halves = sample.sparkSession.sparkContext.broadcast((model(1), model(0)))  # as large as the sample's grams

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in text_blocks(b.column("text")):
                fold = b.column("fold").to_numpy()[lo:hi]
                x = np.where(fold == 0, *(differences(m, share, data, at) for m in halves.value))
                yield batch(toxic=b.column("toxic").slice(lo, hi - lo), x=pa.array(x))

    judged = sample.mapInArrow(crossed, "toxic int, x double").orderBy("toxic", "x").toArrow()  # a number a row of the sample
    label, x = judged.column("toxic").to_numpy(), judged.column("x").to_numpy()
    heavy = np.array([counts.get(k, 0) / max(1, (label == k).sum()) for k in (0, 1)])[label]
    return (model(0, 1), *logistic(x, label, heavy / heavy.mean()))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = SIZE, share: float = SHARE, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text), learnt from labels (doc_id, toxic)."""
    sample, counts = sampled(docs, labels.select("doc_id", "toxic"), rows, size)
    fit = fitted(sample, counts, share)
    dropped(sample)
    shared = docs.sparkSession.sparkContext.broadcast((fit, float(counts.get(1, 0) > 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, only = shared.value
        for b in batches:
            for lo, hi, data, at in text_blocks(b.column("text")):
                if fit:
                    score = 1 / (1 + np.exp(-np.clip(fit[1] * differences(fit[0], share, data, at) + fit[2], -700, 700)))
                else:
                    score = np.full(hi - lo, only)
                yield batch(doc_id=b.column("doc_id").slice(lo, hi - lo), held_out=b.column("held_out").slice(lo, hi - lo), score=pa.array(score), predicted=pa.array((score >= least).astype(np.int32)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir), table(spark, sf_dir, "labels"))
