"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns; results by brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsgrain.llm import fingerprints, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_counts
from newsgrain.llm.common import n_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size int, kept string, bucket int"
PASSAGE = " ".join(f"shared{i}" for i in range(70))
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
TEXTS = [
    (1, "The cat sat on the mat. " * 3 + " ".join(f"a{i}" for i in range(60)), "s1"),
    (2, "The cat sat on the mat. " * 3 + " ".join(f"a{i}" for i in range(60)), "s1"),
    (3, "The cat sat on the mat. " * 3 + " ".join(f"a{i}" for i in range(59)) + " other", None),
    (4, None, "s2"),
    (5, "", "s2"),
    (6, " \n\t ", "s2"),
    (7, "one", "s0"),
    (8, "one", "s0"),
    (9, "ÉTÉ à côté x y\n\nzwei Wörter ß 中文", "s0"),
    (10, "before " + PASSAGE + " after one two", "s3"),
    (11, "other " + PASSAGE + " things here", "s3"),
    (12, LONG, "s3"),
    (12, LONG + " tail", "s3"),
    (13, "a\na\na\nb\n\nb", "s3"),
    (None, "no id but " + PASSAGE, None),
    (None, None, None),
    (15, "x" * 900, "s4"),
    (16, "#*$ %&| <> !!! ??? " * 20, "s4"),
    (17, "<|endoftext|> hello <|startoftext|>", "s4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "r", "k", 1, "x", 2) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def test_ngram_join(docs, empty):
    got = by_id(ngram_join.near_duplicates(docs))

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        if i is not None:
            sets[i].append(shingles(t))
    ids, comp = sorted(sets), {i: i for i in sets}
    for _ in ids:
        for a in ids:
            for b in ids:
                if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: {r.component_id for r in got[i]} for i in ids} == {i: {comp[i]} for i in ids}
    assert {i: sorted(r.n_shingles for r in got[i]) for i in ids} == {i: sorted(map(len, sets[i])) for i in ids}
    assert {r.component_id for r in got[None]} == {None}
    assert ngram_join.near_duplicates(empty).count() == 0


def test_near_copies_in_one_group(spark):
    """A chain and a star of near copies: no link is lost when hubs do not reach all."""
    base = [f"w{i}" for i in range(200)]
    texts = [base[: 200 - 3 * k] + [f"x{k}_{j}" for j in range(3 * k)] for k in range(30)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    comp = list(range(30))
    for _ in range(30):
        for a in range(30):
            for b in range(30):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()} == dict(enumerate(comp))


def test_token_counts(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs, path))
    want = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        want[i].append((len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)))
    assert {i: sorted((r.n_bytes, r.n_tokens) for r in v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert all(r.over_limit == (r.n_tokens > 2048) for v in got.values() for r in v)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_of_odd_texts():
    tokenizers = pytest.importorskip("tokenizers")
    import random

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    tok, count = tokenizers.Tokenizer.from_str(spec), token_counts.counter(spec, token_counts.proved_whole(spec))
    rng, chars = random.Random(3), "abzABÉéßİıΣσςāＡ１½²٣中ªº'’sStT \n\t\x1c\x85\xa0.,!<|>_-09̧́ﬁǅ한😀"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert count(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_lm_scoring(docs, empty):
    got = lm_scoring.lm_scores(docs, lm_scoring.held_out_rule()).collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    order, counts, trie = lm_scoring.ORDER, collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(lm_scoring.ORDER + 1)]
    symbols = lambda t: [257] * order + list(t.encode().lower()) + [256]
    for i, t, _ in TEXTS:
        if not held(i):
            counts.update((t or "").encode().lower().split() + [b"\0end"])
            s = symbols(t or "")
            for j in range(order, len(s)):
                for k in range(order + 1):
                    trie[k][tuple(s[j - k : j])][s[j]] += 1
    n, v = sum(counts.values()), len(counts)

    def score(t):
        s, out = symbols(t), 0.0
        for j in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                here = {x: m for x, m in trie[k].get(tuple(s[j - k : j]), {}).items() if x not in gone}
                if not here:
                    continue
                total = 2 * sum(here.values())
                if s[j] in here:
                    out += math.log10((2 * here[s[j]] - 1) / total)
                    break
                out += math.log10(len(here) / total)
                gone |= here.keys()
            else:
                out -= math.log10(257 - len(gone))
        return out

    want = collections.Counter()
    for i, t, _ in TEXTS:
        w = (t or "").encode().lower().split() + [b"\0end"]
        want[(i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4), round(score(t or ""), 4))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    pieces = lm_scoring.lm_scores(docs, lm_scoring.held_out_rule(), most=300, head=3).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_tokens)
    for a, b in zip(sorted(got, key=key), sorted(pieces, key=key), strict=True):
        assert a.n_known == b.n_known and a.score == pytest.approx(b.score) and a.base_score == pytest.approx(b.base_score)
    assert lm_scoring.lm_scores(empty, lm_scoring.held_out_rule()).count() == 0


def test_quality_classifier(docs, empty):
    got = by_id(quality_classifier.quality_classifier(docs))
    assert sum(map(len, got.values())) == len(TEXTS)
    assert not any(r.kept for i in (4, 5, 6) for r in got[i])
    assert quality_classifier.quality_classifier(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 2048])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = by_id(suffix_dedup.suffix_dedup(docs, ["doc_id", "row", "text"]).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")))
    size = suffix_dedup.WINDOW
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t, _ in TEXTS]
    for _, b in raw:
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    want = collections.defaultdict(list)
    for i, b in raw:
        off, until = [], -1
        for k in range(len(b)):
            if k <= len(b) - size and seen[b[k : k + size]] > 1:
                until = k + size
            off.append(k < until)
        spans = sum(x and not (k and off[k - 1]) for k, x in enumerate(off))
        want[i].append((len(b), sum(off), spans, hashlib.sha256(bytes(c for c, x in zip(b, off, strict=True) if not x)).hexdigest()))
    assert {i: sorted((r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert suffix_dedup.suffix_dedup(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("common", [450, 700])
def test_suffix_dedup_of_a_passage_in_many_texts(spark, monkeypatch, common):
    """One passage between different neighbours: no bucket that is sorted may hold more than HOT rows, and the result stays exact."""
    hot, inner = 8, suffix_dedup.sorted_buckets

    def watched(batches):
        seen = collections.Counter()

        def counted():
            for b in batches:
                seen.update(b.column("bucket").to_pylist())
                assert max(seen.values(), default=0) <= hot
                yield b

        return inner(counted())

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "sorted_buckets", watched)
    own = lambda i, k: "".join(hashlib.sha256(f"{i} {k} {x}".encode()).hexdigest() for x in range(9))
    line = "".join(hashlib.md5(f"line {x}".encode()).hexdigest() for x in range(30))[:common]
    texts = {i: own(i, 0)[: 400 + i] + line + own(i, 1) for i in range(40)}
    got = suffix_dedup.suffix_dedup(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3), ["doc_id"]).collect()
    seen = collections.Counter()
    for t in texts.values():
        seen.update(t[k : k + 400] for k in range(len(t) - 399))
    for r in got:
        t, off = texts[r.row.doc_id], set()
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                off.update(range(k, k + 400))
        assert bytes(r.kept).decode() == "".join(c for k, c in enumerate(t) if k not in off)
        assert r.n_removed >= common and r.n_spans == 1


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.quality_rules(docs, docs.columns).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    want = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i].append((len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert {i: sorted(tuple(r)[1:7] for r in v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert not any(r.kept and r.base_failed for v in got.values() for r in v)
    assert quality_rules.quality_rules(empty, ["doc_id"]).count() == 0


def brute_force_posteriors(patterns, weight=0.03, rounds=200):
    """The same model from single documents, by matrices: rows are documents, not patterns."""
    votes = np.array([v for v, n in patterns for _ in range(n)])
    expected, x = np.array(quality_rules.EXPECTED), (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    good = 1 / (1 + np.exp(-votes.sum(axis=1)))
    for _ in range(rounds):
        prior = (good.sum() + 1) / (len(good) + 2)
        p = [np.tensordot(c, x, (0, 0)) + (1 + weight * len(votes)) * e for c, e in zip((good, 1 - good), expected, strict=True)]
        p = [q / q.sum(axis=1, keepdims=True) for q in p]
        odds = math.log(prior / (1 - prior)) + (x * np.log(p[0] / p[1])).sum(axis=(1, 2))
        good = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    return {tuple(v): g for v, g in zip(votes.tolist(), good, strict=True)}


def test_label_model_against_brute_force():
    rng = np.random.default_rng(4)
    good = rng.random(500) < 0.8
    hit = np.where(good[:, None], [0.05, 0.1, 0.02, 0.15, 0.1], [0.9, 0.7, 0.8, 0.6, 0.5])
    votes = np.where(rng.random((500, 5)) < 0.2, 0, np.where(rng.random((500, 5)) < hit, -1, 1))
    patterns = sorted(collections.Counter(map(tuple, votes.tolist())).items())
    prior, rules = quality_rules.fit(patterns)
    want = brute_force_posteriors(patterns)
    got = {v: quality_rules.posterior(prior, rules, v) for v, _ in patterns}
    assert all(got[v] == pytest.approx(want[v], abs=1e-6) for v in got)
    right = np.mean([(got[tuple(v)] >= 0.5) == g for v, g in zip(votes.tolist(), good, strict=True)])
    assert right > 0.95 and abs(prior - good.mean()) < 0.05
    # learnt, not set: the verdict is neither that of any bad vote nor that of the majority alone
    assert any((got[v] >= 0.5) != (min(v) >= 0) for v in got) and quality_rules.fit([])[0] == 0.5


def test_label_model_keeps_a_clean_corpus():
    """Without bad documents, what the model expects holds and nothing is thrown away for being short."""
    patterns = [((1,) * 11, 900), ((1,) * 8 + (0, 1, 0), 60), ((1,) * 10 + (-1,), 40)]
    prior, rules = quality_rules.fit(patterns)
    assert all(quality_rules.posterior(prior, rules, v) > 0.5 for v, _ in patterns)


def test_quality_verdicts_and_labels(spark):
    """`kept` by brute force from the votes; how verdicts agree with the labels that the table has, which neither operator sees."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = quality_rules.quality_rules(df, ["doc_id"]).select("row.doc_id", "base_failed", "kept", "posterior", *[f"vote_{k}" for k in quality_rules.RULES]).collect()
    votes = {r.doc_id: tuple(r[4:]) for r in rows}
    want = brute_force_posteriors(sorted(collections.Counter(votes[r.doc_id] for r in rows if not r.base_failed).items()))
    assert all(r.kept == (not r.base_failed and want[votes[r.doc_id]] >= 0.5) for r in rows)
    assert sum(r.kept != (min(votes[r.doc_id]) >= 0) for r in rows if not r.base_failed) > 0.02 * len(rows)
    share = lambda kept, q: np.mean([kept[i] for i, x in labels.items() if x == q and i in kept])
    kept = {r.doc_id: r.kept for r in rows}
    assert share(kept, 0) < 0.05 and share({r.doc_id: r.kept for r in rows if not r.base_failed}, 1) > 0.98
    kept = {r.doc_id: r.kept for r in quality_classifier.quality_classifier(df).collect()}
    assert share(kept, 0) < 0.15 and share(kept, 1) > 0.9


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_fingerprints(docs, empty, ranges):
    rows = fingerprints.with_next(docs, ranges).collect()
    order = sorted(((i, t or "") for i, t, _ in TEXTS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = collections.Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert collections.Counter((r.doc_id, r.text, r.next) for r in rows) == want
    f = docs.select("doc_id", "text", fingerprints.fingerprint(F.coalesce("text", F.lit(""))).alias("f"))
    prints = collections.defaultdict(set)
    for r in f.collect():
        prints[r.text or ""].add(r.f)
    assert all(len(v) == 1 for v in prints.values()) and len({x for v in prints.values() for x in v}) == len(prints)
    assert fingerprints.with_next(empty).count() == 0


def test_fingerprint_query_by_brute_force(spark, docs, tmp_path):
    """Edited texts and both likenesses of op7, from leaves and sections cut by plain Python."""
    rows = [(i, t) for i, t, _ in TEXTS if i is not None and i != 12] + [(100 + k, "\n".join(f"clause {j} of text, {j % 7} times; line {k % 3}." for j in range(k % 3, 40 + k))) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    leaf = re.compile(fingerprints.LEAF)
    order = sorted((i, t or "") for i, t in rows)

    def leaves(t):
        return {x.group(0) for x in leaf.finditer(t)}

    def like(a, b):
        x, y = leaves(a) or {""}, leaves(b) or {""}
        return 1.0 if a == b else len(x & y) / len(x | y)

    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, after), 9))
    got = {r.doc_id: r for r in fingerprints.op7_document_fingerprints(spark, str(tmp_path)).collect()}
    assert {i: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for i, r in got.items()} == want
    assert all((r.fingerprint == r.edited_fingerprint) == (dict(order)[i] == dict(order)[i][: len(dict(order)[i]) - len(dict(order)[i]) // 2] + order[([x for x, _ in order].index(i) + 1) % len(order)][1][: len(dict(order)[i]) // 2]) for i, r in got.items())


def test_fingerprints_locate_edits(spark):
    lines = [f"line {i} has some words of its own and ends here." for i in range(200)]
    edited = [*lines[:120], "this line was changed by somebody.", *lines[121:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    r = df.select(fingerprints.likeness(a, b).alias("like"), fingerprints.likeness(a, a).alias("same"), fingerprints.changed(a, b).alias("where"), F.size(fingerprints.part(a, 1)).alias("n")).first()
    assert r.same == 1.0 and 0.8 < r.like < 1.0 and 1 <= len(r.where) <= 4 < r.n


def test_packing(docs, empty):
    out = packing.pack(docs, n_words(F.col("text"))).collect()
    sizes = collections.defaultdict(list)
    for i, t, _ in TEXTS:
        sizes[i].append(len(WORD.findall(t or "")))
    assert {i: sum(r.length for r in out if r.doc_id == i) for i in sizes} == {i: sum(v) for i, v in sizes.items()}
    assert all((r.bin_id is None) == (r.length == 0) for r in out)
    bins = collections.defaultdict(list)
    for r in out:
        if r.length:
            bins[r.bin_id].append((r.bin_start, r.length, r.bin_size))
    for rows in bins.values():
        rows.sort()
        assert len({b for *_, b in rows}) == 1 and rows[0][2] in packing.SIZES
        assert [s for s, *_ in rows] == [sum(n for _, n, _ in rows[:k]) for k in range(len(rows))]
        used = sum(n for _, n, _ in rows)
        assert used <= rows[0][2] and not any(used <= s < rows[0][2] for s in packing.SIZES)
    assert packing.pack(empty, n_words(F.col("text"))).count() == 0


def reference_packer(lengths, sizes, cost):
    """The same rules by plain lists: nothing is indexed, every bin and every length to come is looked at."""
    bins, out = [], []
    for k, n in enumerate(lengths):
        room = lambda b: b["size"] - sum(b["has"])
        fits = [b for b in bins if room(b) >= n]
        if fits:
            least = min(room(b) for b in fits)
            b = [b for b in fits if room(b) == least]
            b = max(b, key=lambda b: b["when"])
        else:

            def filled(s):
                got = n
                for m in lengths[k + 1 :]:
                    if got + m <= s:
                        got += m
                return got

            size = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / filled(s), s))
            b = {"size": size, "has": [], "id": len(bins)}
            bins.append(b)
        b["has"].append(n)
        b["when"] = k
        out.append(b["id"])
    return out, [min(s for s in sizes if s >= sum(b["has"])) for b in bins]


@pytest.mark.parametrize("sizes", [(512, 1024, 2048, 4096), (10, 25, 60)])
def test_best_fit_against_a_plain_packer(sizes):
    top = sizes[-1]
    for seed in range(4):
        lengths = sorted((1 + (i * i * 7919 + seed * 104729) % top for i in range(300)), reverse=True)
        bins, starts, final = packing.best_fit(lengths, sizes)
        assert (bins, final) == reference_packer(lengths, sizes, packing.sequence_cost)
        at = collections.Counter()
        for b, s, n in zip(bins, starts, lengths, strict=True):
            assert s == at[b]
            at[b] += n


def test_several_sizes_cost_less_than_one():
    """Sizes chosen jointly beat the largest alone, and no size is the only one that is opened."""
    lengths = sorted([30 + (i * 7919) % 450 for i in range(2000)] + [600 + (i * 104729) % 3400 for i in range(200)], reverse=True)
    total = lambda final: sum(map(packing.sequence_cost, final))
    _, _, final = packing.best_fit(lengths)
    _, _, largest = packing.best_fit(lengths, (4096,))
    _, _, opened_largest = packing.best_fit(lengths, cost=lambda s: 1 / s)  # the largest is opened always, and downsized
    assert total(final) < 0.98 * total(opened_largest) < total(largest) and len(set(final)) == 4


def test_packing_deals_out_equal_rows(spark):
    for i in (None, 7):
        df = spark.createDataFrame([(i, "a b c")] * 3000, "doc_id long, text string").repartition(4)
        out = packing.pack(df, n_words(F.col("text")), per_shard=50).collect()
        sizes = collections.Counter(r.bin_id >> 32 for r in out)
        assert len(out) == 3000 and {r.doc_id for r in out} == {i} and len(sizes) > 50 and max(sizes.values()) < 100


def test_best_fit_is_tight():
    lengths = sorted((1 + (i * 7919) % 3000 for i in range(3000)), reverse=True)
    bins, starts, final = packing.best_fit(lengths)
    assert sum(lengths) / sum(final) > 0.97 and len(bins) == len(starts) == 3000


def test_substring_dedup(docs, empty):
    for batches in (1, 4):
        got = by_id(substring_dedup.substring_dedup(docs, docs.columns, batches).select("row.doc_id", "n_words", "n_removed", "kept"))
        first, want = {}, collections.defaultdict(list)
        rows = [(i, WORD.findall(t or "")) for i, t, _ in TEXTS]
        for i, w in sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]):
            first.update({tuple(w[k : k + 50]): i for k in range(len(w) - 49)})
        for i, w in rows:
            off = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
            want[i].append((len(w), len(off), " ".join(x for j, x in enumerate(w) if j not in off)))
        assert {i: sorted(tuple(r)[1:] for r in v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
        assert substring_dedup.substring_dedup(empty, ["doc_id"], batches).count() == 0


@pytest.mark.parametrize("often", [4, 16])
def test_substring_dedup_of_a_passage_in_most_texts(spark, monkeypatch, often):
    """A passage in most documents is looked up by its first document alone, and goes to no shard."""
    seen = []
    inner = substring_dedup.Index.first_documents
    monkeypatch.setattr(substring_dedup.Index, "first_documents", lambda self: seen.append(inner(self)) or seen[-1])
    line = [f"shared{i}" for i in range(60)]
    rng = np.random.default_rng(2)
    texts = {i: [f"w{x}" for x in rng.integers(0, 10**9, 30)] + (line if i % often else []) + [f"v{x}" for x in rng.integers(0, 10**9, i)] for i in range(90)}
    texts[90] = [*texts[89], "end"]  # and an ordinary repeat
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    first, want = {}, {}
    for i in sorted(texts, reverse=True):
        first.update({tuple(texts[i][k : k + 50]): i for k in range(len(texts[i]) - 49)})
    for i, w in texts.items():
        off = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want[i] = (len(off), " ".join(x for j, x in enumerate(w) if j not in off))
    got = {r.row.doc_id: (r.n_removed, r.kept) for r in substring_dedup.substring_dedup(df, ["doc_id"]).collect()}
    assert got == want and len(seen[0][0]) >= 11 and set(seen[0][2]) == {1}


def test_mixing(docs, empty):
    m = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for i, t, s in TEXTS:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap, demand = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {s: 2 * n for s, n in sizes.items()}, 1.5 * sum(sizes.values())
    capped: set = set()
    while True:
        level = (demand - sum(cap[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and level * weight[s] > cap[s]}
        if not over:
            break
        capped |= over
    target = {s: cap[s] if s in capped else level * weight[s] for s in names}
    assert {r.source: round(r.target, 6) for r in m} == {s: round(t, 6) for s, t in target.items()}
    assert all(r.taken <= 2 * r.size and (r.position is None) == (r.copies == 0) for r in m)
    for s in names:
        largest = max(r.size for r in m if r.source == s)
        assert abs(sum(r.taken for r in m if r.source == s) - target[s]) <= largest
    again = mixing.mix(docs.repartition(5), ranges=4096).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again) == sorted((r.doc_id or -1, r.size, r.taken) for r in m)
    assert mixing.mix(empty).count() == 0
    # every copy that the plan takes comes out once, with all columns, those that clash included
    got = mixing.placed(docs, mixing.mix(docs)).collect()
    want = collections.Counter()
    for r in m:
        want[(r.doc_id, r.size)] += r.copies
    assert collections.Counter((r.row.doc_id, len(WORD.findall(r.row.text or ""))) for r in got) == +want
    assert all(r.row.kept == "x" and r.row.bucket == 2 and r.row.row == "r" for r in got)


def test_mixing_of_equal_rows(spark):
    """Rows equal in doc_id, source and text are taken as often as the plan says, whichever other columns they have."""
    rows = [(1, "a b c", "s", k % 2) for k in range(6)] + [(None, "d e", "s", 0)] * 5 + [(2, "x y z w", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(3)
    plan = mixing.mix(df)
    copies = {(r.doc_id, r.nth): r.copies for r in plan.collect()}
    assert len(copies) == len(rows)
    got = collections.Counter(r.row.doc_id for r in mixing.placed(df, plan).collect())
    assert got == +collections.Counter({i: sum(n for (j, _), n in copies.items() if j == i) for i in (1, None, 2)})


def test_pipeline_stages(spark, docs, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for d in (docs.select(columns), empty.select(columns)):
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, "")
            if name != "packing":
                assert d.columns == columns
            d = d.cache()
            d.count()
