"""Votes, weak labels and scores of the quality classifier against plain loops over single texts."""

import re

import numpy as np
import pytest

from newsgrain.llm import quality_classifier as Q
from tests.llm.test_edge_cases import LONG, TEXTS, brute_force_posteriors

SF = "/root/testdata/sf0.001"


def plain(text):
    """Votes, words and (number, repetition, variety) of one text."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, low = len(words), [w.lower() for w in words]
    if not n:
        return (0,) * 10, words, (0, 0.0, 0.0)
    ends = [re.findall(rb"[^\x20\x09-\x0D]+", x)[-1] for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    closed = sum(w.endswith((b".", b"!", b"?", "。".encode(), "！".encode(), "？".encode())) for w in ends)
    symbols = lambda x: sum(x.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    fives = [tuple(low[k : k + 5]) for k in range(n - 4)]
    repeated = 1 - len(set(fives)) / len(fives) if fives else 0.0
    distinct, mean = len(set(low)) / n, sum(map(len, words)) / n
    odd = sum(symbols(w) > 0 for w in words) / n
    small = sum(len(w) - (w[-1:] in (b".", b",", b";", b":", b"!", b"?", b"|")) <= 3 for w in words) / n
    capitals, marks = len(re.findall(rb"[A-Z]", raw)) / sum(map(len, words)), raw.count(b"!") + raw.count(b"?")
    said = [
        (symbols(raw) > 0.1 * n, symbols(raw) == 0),
        (odd > 0.2, odd < 0.02),
        (small < 0.15, 0.2 <= small <= 0.6),
        (mean < 4.2 or mean > 7.5, 4.4 <= mean <= 7),
        (len(ends) > 1 and closed < 0.95 * len(ends), len(ends) > 1 and closed == len(ends)),
        (distinct < 0.5, distinct >= 0.6),
        (capitals > 0.3, capitals < 0.1),
        (marks > 0.1 * n, marks == 0),
        (repeated > 0.05, repeated == 0),
        (n < 40, n >= 80),
    ]
    return tuple(-1 if bad else int(good) for bad, good in said), words, (n, repeated, distinct)


def places(word, known={}):  # noqa: B006
    """Buckets of a word that stands alone, and of its shape."""
    if word not in known:
        _, _, w, s, _ = Q.described(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        known[word] = int(w[0]), int(s[0])
    return known[word]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(i, t) for i, t, _ in TEXTS] + [(9001, LONG), (9002, LONG), (9003, "Closed。\nOpen\n" * 50), (9003, "Closed。\nOpen\n" * 50)]


def test_scores_against_plain_loops(spark, corpus):
    texts = {t for _, t in corpus}
    told = {t: plain(t) for t in texts}
    own = [t for _, t in corpus if told[t][2][0]]
    votes = [told[t][0] for t in own]
    belief = brute_force_posteriors([(v, votes.count(v)) for v in sorted(set(votes))])

    def row(t):
        x, (n, repeated, distinct) = np.zeros(Q.FEATURES + 1), told[t][2]
        for w in told[t][1]:
            for k in places(w):
                x[k] += 1 / n
        at = 2 * Q.BUCKETS
        for value, bounds in zip((n, repeated, distinct), Q.LEVELS, strict=True):
            x[at + sum(value > b for b in bounds)] += 1
            at += len(bounds) + 1
        x[-1] = 1
        return x

    x, y = np.array([row(t) for t in own]), np.array([belief[v] for v in votes])
    heavy, weights, seen = y / y.sum() + (1 - y) / (1 - y).sum(), np.zeros(x.shape[1]), 1e-6
    for _ in range(200):
        step = x.T @ ((1 / (1 + np.exp(-x @ weights)) - y) * heavy)
        seen = seen + step**2
        weights -= 0.5 * step / np.sqrt(seen)
    score = {t: 1 / (1 + np.exp(-row(t) @ weights)) if told[t][2][0] else 0.0 for t in texts}

    df = spark.createDataFrame([(k, *r) for k, r in enumerate(corpus)], "row long, doc_id long, text string")
    got = {r.doc_id: r for r in Q.quality_classifier(df.select(df.row.alias("doc_id"), "text")).collect()}
    assert len(got) == len(corpus)
    for k, (_, t) in enumerate(corpus):
        r = got[k]
        assert r.n_words == told[t][2][0]
        assert r.weak_label == pytest.approx(belief[told[t][0]] if r.n_words else 0.0, abs=1e-6)
        assert r.score == pytest.approx(score[t], abs=1e-3)
        assert r.kept == (r.score >= 0.5)
    assert 0 < sum(r.kept for r in got.values()) < len(got)


def test_ties_and_repeated_rows_are_scored_alike(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    rows = Q.quality_classifier(df).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id, []).append(r)
    assert by_text[9001][0].score == by_text[9002][0].score
    assert len(by_text[9003]) == 2 and len(set(by_text[9003])) == 1
    # a score that equals the limit keeps
    limit = by_text[9001][0].score
    again = {r.doc_id: r.kept for r in Q.quality_classifier(df, least=limit).where("doc_id IN (9001, 9002)").collect()}
    assert again == {9001: True, 9002: True}


def test_votes_of_single_texts():
    for _, t, _ in TEXTS:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        votes, wo, _, _, levels = Q.described(raw, np.array([0, len(raw)]))
        want, words, (n, repeated, distinct) = plain(t)
        assert tuple(votes[0]) == want and wo[1] - wo[0] == len(words)
        assert [int(v) for v in levels[0]] == [2 * Q.BUCKETS + sum(n > b for b in Q.LEVELS[0]), 2 * Q.BUCKETS + 8 + sum(repeated > b for b in Q.LEVELS[1]), 2 * Q.BUCKETS + 14 + sum(distinct > b for b in Q.LEVELS[2])]
