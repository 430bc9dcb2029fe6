"""corpus_pipeline.run() against a chain of plain loops, one for each stage."""

import collections
import hashlib
import math
import re

import numpy as np

import corpus_pipeline
from newsgrain.llm import packing, quality_rules

from .test_edge_cases import brute_force_posteriors, reference_packer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = np.random.default_rng(11)
    small = ["the", "of", "and", "to", "in"]
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(4, 9))) for _ in range(600)]

    def prose(n):
        words = [str(rng.choice(small)) if rng.random() < 0.35 else str(rng.choice(vocabulary)) for _ in range(n)]
        lines = [" ".join(words[i : i + 12]) + "." for i in range(0, n, 12)]
        return "\n".join(lines)

    passage = " ".join(str(rng.choice(vocabulary)) for _ in range(70))
    texts = [prose(int(n)) for n in rng.integers(30, 700, 60)]
    texts += [t + " tail end" for t in texts[:8]] + texts[10:14]  # near and exact copies
    texts += [prose(90) + "\n" + passage + ".\n" + prose(60) for _ in range(4)]  # one passage in several
    texts += [" | ".join(prose(60).split()) + " |", "### &&& %%% " * 20, "short text", None, "", passage, "WORD!! " * 60]
    texts += [" ".join(w + "***" for w in prose(80).split()), prose(9000)]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def votes_of(t):
    w, n = WORD.findall(t), len(WORD.findall(t))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars, d = max(sum(map(len, w)), 1), max(n, 1)
    symbols, odd = sum(x in "#*$%&|<>" for x in t), sum(any(c in "#*$%&|<>" for c in x) for x in w)
    short, distinct, dup = sum(len(x) <= 3 for x in w), len(set(w)), len(lines) - len(set(lines))
    ends = sum(re.search(r"[.!?。！？…][\"'”’»)\]]*\s*$", x) is not None for x in lines)
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    repeats = len({j for k in range(n - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
    capitals, marks, several = sum(x.isupper() for x in t), sum(x in "!?" for x in t), len(lines) > 1

    def v(bad, good):
        return 0 if not n else -1 if bad else 1 if good else 0

    votes = (
        v(symbols > 0.1 * n, symbols == 0), v(odd > 0.2 * n, odd < 0.02 * n), v(short < 0.12 * n, 0.16 * n <= short <= 0.6 * n), v(chars < 4.2 * n or chars > 7 * n, 4.4 * n <= chars <= 6.5 * n),
        v(several and ends < 0.95 * len(lines), several and ends >= len(lines)), v(distinct < 0.5 * n, distinct >= 0.6 * n), v(capitals > 0.3 * chars, capitals < 0.1 * chars), v(marks > 0.1 * n, marks == 0),
        v(dup > 0.2 * len(lines), several and dup == 0), v(repeats > 0.05 * d, repeats == 0), v(n < 40, n >= 80),
    )
    return votes, n < 20 or 100 * repeats > 30 * n


def filtered(docs):
    judged = {i: votes_of(t or "") for i, t, *_ in docs}
    post = brute_force_posteriors(sorted(collections.Counter(v for v, failed in judged.values() if not failed).items()))
    return [d for d in docs if not judged[d[0]][1] and post[judged[d[0]][0]] >= 0.5]


def without_copies(docs):
    sets = {}
    for i, t, *_ in docs:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return [d for d in docs if group[d[0]] == d[0]]


def without_passages(docs):
    first, out = {}, []
    for i, t, *_ in sorted(docs, key=lambda d: -d[0]):
        w = WORD.findall(t)
        first.update({tuple(w[k : k + 50]): i for k in range(len(w) - 49)})
    for i, t, lang, source, n in docs:
        w = WORD.findall(t)
        off = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in off)
        if not off or kept:
            out.append((i, kept if off else t, lang, source, len(kept) if off else n))
    return out


def mixed(docs):
    """Each document as often as the mix takes it."""
    size = {d[0]: len(WORD.findall(d[1])) for d in docs}
    total = collections.Counter()
    for d in docs:
        total[d[3]] += size[d[0]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, cap, demand, capped = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {s: 2 * n for s, n in total.items()}, 1.5 * sum(total.values()), set()
    while True:
        level = (demand - sum(cap[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and level * weight[s] > cap[s]}
        if not over:
            break
        capped |= over
    out, start = [], collections.Counter()
    for d in sorted(docs, key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()):
        s, n = d[3], size[d[0]]
        target = cap[s] if s in capped else level * weight[s]
        passes = math.floor(target / max(total[s], 1))
        out += [d] * (passes + (n > 0 and 2 * start[s] + n <= 2 * (target - passes * total[s])))
        start[s] += n
    return out


def packed(docs):
    """Lengths of parts with their documents, by bin."""
    parts = []
    for i, t, *_ in docs:
        n, top = len(WORD.findall(t)), max(packing.SIZES)
        parts += [(min(top, n - k * top), i, k) for k in range(max(1, -(-n // top)))]
    parts.sort(key=lambda p: (-p[0], p[1], p[2]))
    bins, final = reference_packer([p[0] for p in parts], packing.SIZES, packing.sequence_cost)
    held = collections.defaultdict(list)
    for b, (n, i, k) in zip(bins, parts, strict=True):
        held[b].append((i, k, n))
    return collections.Counter((final[b], tuple(sorted(v))) for b, v in held.items())


def test_run_against_plain_loops(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = filtered(docs)
    once = without_copies(kept)
    cut = without_passages(once)
    many = mixed(cut)
    assert len(docs) > len(kept) > len(once) >= len(cut) and any(a != b for a, b in zip(once, cut, strict=False)) and len(many) > len(cut)
    got = collections.defaultdict(list)
    size = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.bin_id].append((r.doc_id, r.part, r.length))
        size[r.bin_id] = r.bin_size
    assert collections.Counter((size[b], tuple(sorted(v))) for b, v in got.items()) == packed(many)


def test_stages_carry_columns_of_any_name(spark):
    """Columns that are named like those that the stages use inside go through untouched."""
    odd = ["_gone", "_twice", "r", "row", "kept", "tie", "position", "repeats", "doc", "again", "n_removed"]
    docs = [(*d, *range(len(odd))) for d in corpus()]
    docs += [docs[0], (None, docs[1][1], *docs[1][2:])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in odd)).repartition(2)
    for name, f in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(f(spark, df, "").collect(), df.schema)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *odd], name
        assert {tuple(r[5:]) for r in df.collect()} == {tuple(range(len(odd)))}, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() > 0


def test_results_live_side_by_side(spark, tmp_path):
    """A result stays readable after a further run, in another session."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, docs in (("a", corpus()), ("b", corpus()[:40])):
        spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = lambda df: sorted(map(repr, df.collect()))
    a = corpus_pipeline.run(spark, str(tmp_path / "a"))
    first = rows(a)
    b = corpus_pipeline.run(spark.newSession(), str(tmp_path / "b"))
    assert first and rows(a) == first and rows(b) != first and a.saved_path != b.saved_path


def test_stages_of_two_chains_in_turn(spark, tmp_path):
    """Stages called by themselves, of two chains in turn and written late, do not take each other's tables."""
    df = spark.createDataFrame(corpus()[:40], "doc_id long, text string, lang string, source string, n_chars long")
    chains = {"a": df, "b": df}
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        lazy = {name: f(spark, d, "") for name, d in chains.items()}
        for name, d in lazy.items():
            d.write.parquet(str(tmp_path / f"{name}{k}"))
            chains[name] = spark.read.parquet(str(tmp_path / f"{name}{k}"))
    a, b = (sorted(map(repr, d.collect())) for d in chains.values())
    assert a and a == b
