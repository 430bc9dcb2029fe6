"""Quality classifier learnt from weak labels.

Heuristic labellers that overlap vote good, bad or abstain on every document. Expectation-maximisation over the histogram of vote patterns of all documents (at most 3**10) estimates their
accuracies; the posterior is the label. A linear scorer over hashed words, hashed word shapes and levels of length, repetition and variety is then fitted to the posteriors of a bounded sample, and
scores every document.

The sample is the `sample` rows (a parameter) with the least hash of doc_id and text; it is all that the driver holds. Votes, pattern counts and scores cover all rows and whole texts, however
long. A text without words (null, empty) has score 0 and is not kept. Rows with a null doc_id and repeated rows are scored each for itself, and equal texts alike. A score equal to `least`
keeps. Other columns, of any name, are not read. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import IS_SPACE, STEP, U, batch, lists, mixed, rolling, text_blocks, word_hashes
from .common import table
from .quality_rules import fit, posterior

BUCKETS = 1 << 13  # of words, and as many of shapes
SAMPLE = 8192
LABELLERS = ("symbols", "symbol_words", "short_words", "word_length", "line_ends", "distinct", "capitals", "marks", "repeats", "length")
#: Upper bounds of the levels of a text's length in words, its share of repeated 5-grams and its share of distinct words.
LEVELS = (np.array([5, 10, 20, 40, 80, 160, 640]), np.array([0.01, 0.05, 0.15, 0.3, 0.6]), np.array([0.1, 0.25, 0.5, 0.7, 0.9]))
FEATURES = 2 * BUCKETS + sum(len(x) + 1 for x in LEVELS)
_upper, _symbol, _mark, _stop = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), b"#*$%&|<>", b"!?", b".!?"))


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _weighed(values: np.ndarray, wo: np.ndarray) -> np.ndarray:
    """Sum of each text's values, added text by text, so that equal texts have equal sums wherever they lie."""
    held, out = wo[1:] > wo[:-1], np.zeros(len(wo) - 1)
    if held.any():
        out[held] = np.add.reduceat(values, wo[:-1][held])
    return out


def described(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts x labellers), offsets of each text's words, the bucket of each word and of its shape, and the places of each text's levels."""
    words, starts, wo = word_hashes(data, at, lower=True)
    n = np.diff(wo)
    lead = starts[0] if len(starts) else 0
    each = lambda flags: np.add.reduceat(flags[lead:].astype(np.int64), starts - lead) if len(starts) else np.empty(0, np.int64)
    size = each(~IS_SPACE[data])
    last = data[starts + size - 1] if len(starts) else np.empty(0, np.uint8)
    # closed: the word ends a sentence; in CJK text with one of three marks of three bytes
    wide = np.concatenate([np.zeros(2, np.int64), data.astype(np.int64)])
    three = (wide[starts + size - 1] << 16 | wide[starts + size] << 8 | wide[starts + size + 1]) if len(starts) else np.empty(0, np.int64)
    closed = _stop[last] | np.isin(three, (0xE38082, 0xEFBC81, 0xEFBC9F))
    line = np.cumsum(data == 10)[starts] if len(starts) else np.empty(0, np.int64)
    final = np.ones(len(starts), bool)
    final[:-1] = line[1:] != line[:-1]
    final[wo[1:][n > 0] - 1] = True
    lines, ends = _per_text(final, wo), _per_text(final & closed, wo)
    grams = rolling(words, 5)
    spans = list(zip(wo[:-1], wo[1:], strict=True))
    repeated = np.array([1 - len(np.unique(grams[a : e - 4])) / (e - a - 4) if e - a >= 5 else 0.0 for a, e in spans])
    w = np.maximum(n, 1)
    distinct = np.array([len(np.unique(words[a:e])) for a, e in spans], np.int64) / w
    letters = np.maximum(_per_text(~IS_SPACE[data], at), 1)
    small = _per_text(size - np.isin(last, list(b".,;:!?|")) <= 3, wo) / w
    mean = _per_text(size, wo) / w
    odd = _per_text(each(_symbol[data]) > 0, wo) / w

    def vote(bad, good=None):
        return np.where(n == 0, 0, np.where(bad, -1, 0 if good is None else np.where(good, 1, 0)))

    symbols, capitals, marks = _per_text(_symbol[data], at), _per_text(_upper[data], at) / letters, _per_text(_mark[data], at)
    votes = np.stack([
        vote(symbols > 0.1 * w, symbols == 0),
        vote(odd > 0.2, odd < 0.02),
        vote(small < 0.15, (small >= 0.2) & (small <= 0.6)),
        vote((mean < 4.2) | (mean > 7.5), (mean >= 4.4) & (mean <= 7)),
        vote((lines > 1) & (ends < 0.95 * lines), (lines > 1) & (ends == lines)),
        vote(distinct < 0.5, distinct >= 0.6),
        vote(capitals > 0.3, capitals < 0.1),
        vote(marks > 0.1 * w, marks == 0),
        vote(repeated > 0.05, repeated == 0),
        vote(n < 40, n >= 80),
    ], axis=1)
    first = data[starts] if len(starts) else last
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else last
    shape = mixed(last.astype(U) | _upper[first].astype(U) << U(8) | (_upper[second] & (size > 1)).astype(U) << U(9) | np.minimum(size, 31).astype(U) << U(10) | STEP << U(20))
    levels, base = [], 2 * BUCKETS
    for x, bounds in zip((n, repeated, distinct), LEVELS, strict=True):
        levels.append(base + np.searchsorted(bounds, x, "left"))
        base += len(bounds) + 1
    return votes, wo, (words % U(BUCKETS)).astype(np.int64), (shape % U(BUCKETS)).astype(np.int64) + BUCKETS, np.stack(levels, axis=1)


def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, at in text_blocks(b.column("text")):
            votes, wo, *_ = described(data, at)
            kinds, n = np.unique(votes[np.diff(wo) > 0], axis=0, return_counts=True)
            yield batch(votes=pa.array(["".join(map(str, r + 1)) for r in kinds], pa.string()), n=pa.array(n, pa.int64()))


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, at in text_blocks(b.column("text")):
            votes, wo, words, shapes, levels = described(data, at)
            rows = [np.unique(np.concatenate([words[a:e], shapes[a:e]]), return_counts=True) for a, e in zip(wo[:-1], wo[1:], strict=True)]
            # a level counts as often as there are words, so that its share is 1
            rows = [(np.append(x, own), np.append(k, np.full(len(own), e - a))) for (x, k), own, a, e in zip(rows, levels, wo[:-1], wo[1:], strict=True)]
            yield batch(votes=pa.array(["".join(map(str, r + 1)) for r in votes], pa.string()), n=pa.array(np.diff(wo), pa.int64()), at=lists([x for x, _ in rows]), times=lists([x for _, x in rows]))


def train(sample: pa.Table, label: np.ndarray, rounds: int = 200, rate: float = 0.5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer of word shares, by adaptive gradient steps over the whole sample."""
    n = np.maximum(sample.column("n").to_numpy(), 1)
    size = np.array([len(x) for x in sample.column("at").to_pylist()], np.int64)
    at = np.concatenate([np.asarray(x, np.int64) for x in sample.column("at").to_pylist()] or [np.empty(0, np.int64)])
    x = np.concatenate([np.asarray(v, float) for v in sample.column("times").to_pylist()] or [np.empty(0)])
    row = np.repeat(np.arange(len(n)), size)
    x = x / n[row]
    weights, seen = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    # both classes weigh the same, else the rarer is not learnt
    heavy = label / max(label.sum(), 1e-9) + (1 - label) / max((1 - label).sum(), 1e-9)
    for _ in range(rounds if len(n) else 0):
        z = np.bincount(row, weights=weights[at] * x, minlength=len(n)) + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = (p - label) * heavy
        step = np.append(np.bincount(at, weights=error[row] * x, minlength=FEATURES), error.sum())
        seen += step * step
        weights -= rate * step / np.sqrt(seen)
    return weights


def quality_classifier(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, weak_label (posterior of the votes), score (of the linear scorer) and kept, for docs (doc_id, text)."""
    spark = docs.sparkSession
    patterns = docs.select("text").mapInArrow(voted, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    known = sorted((tuple(int(c) - 1 for c in r.votes), r.n) for r in patterns)
    prior, rules = fit(known)
    belief = {"".join(str(x + 1) for x in v): posterior(prior, rules, v) for v, _ in known}
    hashed = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h")).where(F.length("text") > 0)
    # the largest hash up to which there are no more than `sample` rows, among about twice as many hashes; equal rows are in together or out
    share = min(1.0, 2 * sample / max(1, sum(n for _, n in known)))
    upto, held = -1, 0
    for h, n in hashed.where(F.col("h") < F.lit(int(share * (1 << 30)))).groupBy("h").count().orderBy("h").limit(sample).collect():
        held += n
        if held > sample:
            break
        upto = h
    few = hashed.where(F.col("h") <= upto).select("text")
    rows = few.mapInArrow(sampled, "votes string, n long, at array<long>, times array<long>").where("n > 0").toArrow()
    weights = train(rows, np.array([belief[v] for v in rows.column("votes").to_pylist()]))
    shared = spark.sparkContext.broadcast((weights, belief))  # BUCKETS and at most 3**10 entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, belief = shared.value
        for b in batches:
            for lo, hi, data, at in text_blocks(b.column("text")):
                votes, wo, words, shapes, levels = described(data, at)
                n = np.diff(wo)
                z = _weighed(weights[words] + weights[shapes], wo) / np.maximum(n, 1) + weights[levels].sum(axis=1) + weights[-1]
                score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                weak = [belief.get("".join(map(str, v + 1)), 0.0) if m else 0.0 for v, m in zip(votes, n, strict=True)]
                yield batch(doc_id=b.column("doc_id").slice(lo, hi - lo), n_words=pa.array(n, pa.int64()), weak_label=pa.array(weak, pa.float64()), score=pa.array(score), kept=pa.array(score >= least))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, weak_label double, score double, kept boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir))
