"""Column expressions; all built in, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NA = ("n/a", "na", "none", "null", "n/a.", "")
STOP_NOUNS = ("cooperation", "forum", "meeting", "summit", "conference")


def split_multi(c: Column) -> Column:
    """Parts of a `;`-separated list, trimmed, without empties."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def normalize_na(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.lower(t).isin(*NA), None).otherwise(t)


def parse_flexible_date(c: Column) -> Column:
    t = F.trim(c)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    us = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "M/d/yyyy"))
    long_ = F.when(t.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.try_to_date(F.initcap(t), "d MMMM yyyy"))
    return F.coalesce(iso, us, long_)


def ilike_any(c: Column, names: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | c.ilike(f"%{n}%")
    return out


def self_reported(geo: Column, name: Column) -> Column:
    """geo ILIKE '%name%'; null when geo is. `_` and `%` in names are wildcards."""
    return F.ilike(geo, F.concat(F.lit("%"), name, F.lit("%")))


def framing_class(geo: Column, adversaries: Sequence[str], partners: Sequence[str]) -> Column:
    return F.when(ilike_any(geo, adversaries), "adversary").when(ilike_any(geo, partners), "partner").otherwise("neutral/other")


def materiality_band(score: Column) -> Column:
    return F.when(score.isNull(), "unscored").when(score < 4, "symbolic").when(score < 7, "developing").otherwise("substantive")


def band_bounds(band: str) -> tuple[float | None, float | None]:
    return {"symbolic": (None, 4.0), "developing": (4.0, 7.0), "substantive": (7.0, None)}[band]


def clean_subcategory(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[A-Z]\.\s*", ""), r"(?i)^other-", ""))


def normalize_event_name(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")
    t = F.regexp_replace(t, r"\b\d+(st|nd|rd|th)\b", "")
    t = F.regexp_replace(t, r"\b(" + "|".join(STOP_NOUNS) + r")\b", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def story_phase(first: Column, last: Column, articles: Column, days: Column, ref: Column) -> Column:
    return (
        F.when(F.datediff(ref, last) > 30, "dormant")
        .when(F.datediff(ref, last) > 14, "fading")
        .when(F.datediff(ref, first) <= 7, "emerging")
        .when((articles >= 5 * F.greatest(days, F.lit(1))) & (days >= 3), "peak")
        .otherwise("developing")
    )


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two blanks before and one after."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)).cast("double"), F.lit(0.0)), F.lit(0.0))


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def cosine_similarity(u: Column, v: Column) -> Column:
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norm > 0, dot(u, v) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def dominant_key(m: Column) -> Column:
    """Key of the largest count, the smaller key on ties; null for an empty map."""
    return F.get(top_keys(m, 1), F.lit(0))


def ranked_keys(m: Column) -> Column:
    """Keys by their counts, largest first, the smaller key on ties."""
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), lambda e: e["k"])


def top_keys(m: Column, k: int) -> Column:
    return F.slice(ranked_keys(m), 1, k)


def union_arrays_ordered(a: Column, b: Column) -> Column:
    """Distinct values of a in their order, then those that only b has, in theirs; a missing array is empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def merge_count_maps(a: Column, b: Column) -> Column:
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def iso_week_start(week: Column) -> Column:
    """Monday of `YYYY-Www`."""
    jan4 = F.make_date(F.substring(week, 1, 4).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.trunc(jan4, "week"), (F.substring(week, 7, 2).cast("int") - 1) * 7)


def month(c: Column) -> Column:
    return F.trunc(c, "month")


def citation(source: Column, id_: Column, title: Column, date: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(source, F.lit("Unknown")), F.lit("] "), id_.cast("string"), F.lit(": "), F.coalesce(title, F.lit("Untitled")), F.lit(", "), F.date_format(date, "d MMMM yyyy"))


def inline_citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_\-:.]+)\]"), F.lit(1))
