"""Quality rules as weak supervision, in DataFrame functions only.

Eleven rules that overlap (several look at the same fault from different sides and at different levels) vote good, bad or abstain on each document. Expectation-maximisation over the histogram
of vote patterns (at most 3**11 rows whatever the corpus size, some hundreds in practice, which is all that the driver sees) estimates how each rule votes on good and on bad documents; a document
is kept when its posterior probability of being good reaches `least`, so one bad vote that the other rules contradict does not reject it. Documents that fail the base rules are
rejected whatever the votes and are not learnt from. The features are computed once, in one scan, and written to the shared folder.

Null and empty texts have no words: the four measures are 0, all rules abstain and base_failed is true. Very long texts are measured whole. Repeated rows are judged each for itself, and equal
texts alike; rows with a null doc_id are judged like others. A posterior equal to `least` keeps. An empty table gives an empty result. Any further columns may have any names: they travel in a
struct."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 8
RULES = ("symbols", "symbol_words", "short_words", "word_length", "line_ends", "distinct", "capitals", "marks", "lines", "repeats", "length")
#: A word of four characters or more; the part of a word from its first symbol on; the end of a line that closes a sentence. Each starts where it can match, so a text is passed once.
LONG_WORD = r"[^\x20\x09-\x0D]{4,}+"
SYMBOL_WORD = r"[#*$%&|<>][^\x20\x09-\x0D]*+"
LINE_END = r"[.!?。！？…][\"'”’»)\]]*+[\x20\x09\x0B-\x0D]*+(?:\n|\z)"


def _chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns in the struct `row`, and the measures of each text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), t.alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    grams = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.select("row", "t", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), grams.alias("g"), lines.alias("l"))
    again = F.size(F.array_distinct("g")) < F.size("g")
    d = d.withColumn("s", F.when(again, F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"])
    d = d.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter("s", lambda x, k: F.coalesce(twin(x, k), (F.get("s", k + 1)["h"] == x["h"]), (F.get("s", k - 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"]))))
    step = F.transform("p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - p, F.lit(WINDOW))).cast("long"))
    return d.select(
        "row",
        "n_words",
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        _chars(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("t", r"\P{Lu}", "")).cast("long").alias("n_capitals"),
        _chars(F.col("t"), "!?").alias("n_marks"),
        "n_distinct",
        *[F.regexp_count("t", F.lit(p)).cast("long").alias(c) for c, p in (("n_long", LONG_WORD), ("n_symbol_words", SYMBOL_WORD), ("n_ends", LINE_END))],
    )


def votes() -> dict[str, Column]:
    """-1 bad, 1 good, 0 abstains, for each rule."""
    n = F.col("n_words")

    def vote(bad: Column, good: Column | None = None) -> Column:
        v = F.when(n == 0, 0).when(bad, -1)
        return (v if good is None else v.when(good, 1)).otherwise(0).cast("int")

    chars = F.greatest(F.col("word_chars"), F.lit(1))
    c, several = F.col, F.col("n_lines") > 1
    return {
        "symbols": vote(c("n_symbols") > 0.1 * n, c("n_symbols") == 0),
        "symbol_words": vote(c("n_symbol_words") > 0.2 * n, c("n_symbol_words") < 0.02 * n),
        "short_words": vote(n - c("n_long") < 0.12 * n, (n - c("n_long") >= 0.16 * n) & (n - c("n_long") <= 0.6 * n)),
        "word_length": vote((chars < 4.2 * n) | (chars > 7 * n), (chars >= 4.4 * n) & (chars <= 6.5 * n)),
        "line_ends": vote(several & (c("n_ends") < 0.95 * c("n_lines")), several & (c("n_ends") >= c("n_lines"))),
        "distinct": vote(c("n_distinct") < 0.5 * n, c("n_distinct") >= 0.6 * n),
        "capitals": vote(c("n_capitals") > 0.3 * chars, c("n_capitals") < 0.1 * chars),
        "marks": vote(c("n_marks") > 0.1 * n, c("n_marks") == 0),
        "lines": vote(c("n_dup_lines") > 0.2 * c("n_lines"), several & (c("n_dup_lines") == 0)),
        "repeats": vote(c("n_repeat_words") > 0.05 * n, c("n_repeat_words") == 0),
        "length": vote(n < 40, n >= 80),
    }


#: What is expected of a rule before any document is seen: P(bad), P(abstains), P(good) on a good and on a bad document.
EXPECTED = ((0.05, 0.25, 0.70), (0.50, 0.30, 0.20))


def fit(patterns: list[tuple[tuple[int, ...], int]], weight: float = 0.03, rounds: int = 200) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Prior of good, and for each rule P(vote | good), P(vote | bad), from (votes, count) pairs.

    Maximum a posteriori: the first belief is the majority of the votes, and the expectation EXPECTED counts as much as `weight` of all documents, so it holds where no document is of a class and fades
    where the votes say otherwise. Classes have no names of their own; if what came out as good has the lower mean vote, the two are exchanged."""
    rules_n, total = len(patterns[0][0]) if patterns else len(RULES), sum(n for _, n in patterns)
    belief = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in patterns}
    heavy = 1 + weight * total
    start = [{x: (EXPECTED[0][x + 1], EXPECTED[1][x + 1]) for x in (-1, 0, 1)} for _ in range(rules_n)]
    prior, rules = 0.5, start
    for _ in range(rounds if patterns else 0):
        good = sum(n * belief[v] for v, n in patterns)
        prior, rules = (good + 1) / (total + 2), []
        for k in range(rules_n):
            held = {x: [heavy * EXPECTED[c][x + 1] for c in (0, 1)] for x in (-1, 0, 1)}
            for v, n in patterns:
                held[v[k]][0] += n * belief[v]
                held[v[k]][1] += n * (1 - belief[v])
            sums = [sum(h[c] for h in held.values()) for c in (0, 1)]
            rules.append({x: (h[0] / sums[0], h[1] / sums[1]) for x, h in held.items()})
        before, belief = belief, {v: posterior(prior, rules, v) for v, _ in patterns}
        if max(abs(belief[v] - before[v]) for v in belief) < 1e-9:
            break
    lean = sum(r[1][0] - r[-1][0] - r[1][1] + r[-1][1] for r in rules)
    return (prior, rules) if lean >= 0 else (1 - prior, [{x: (q, p) for x, (p, q) in r.items()} for r in rules])


def posterior(prior: float, rules: list[dict[int, tuple[float, float]]], v: tuple[int, ...]) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, log_odds(prior, rules, v)))))


def log_odds(prior: float, rules: list[dict[int, tuple[float, float]]], v: tuple[int, ...]) -> float:
    return math.log(prior / (1 - prior)) + sum(math.log(r[x][0] / r[x][1]) for r, x in zip(rules, v, strict=True))


def quality_rules(docs: DataFrame, carry: list[str], least: float = 0.5) -> DataFrame:
    """Struct `row` of the carried columns, the measures, base_failed, the votes, `posterior` and `kept`."""
    f = saved(features(docs, carry).withColumns({f"vote_{k}": v for k, v in votes().items()}), "quality")
    names = [f"vote_{k}" for k in RULES]
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in f.where("n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words").groupBy(*names).count().collect())
    prior, rules = fit(patterns)
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, r in zip(names, rules, strict=True):
        a, b, c = (math.log(r[x][0] / r[x][1]) for x in (-1, 0, 1))
        odds = odds + F.when(F.col(name) == -1, a).when(F.col(name) == 1, c).otherwise(b)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = f.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", *[f"vote_{k}" for k in RULES])
