"""Time series: scores, anomalies, changepoints, trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_zscore(daily: DataFrame, keys: list[str], rows: int = 30, least: int = 7, z: float = 2.0) -> DataFrame:
    """Trailing mean and sample deviation over the last rows, the current one included; 0 under `least` rows or without deviation."""
    w = W.partitionBy(*keys).orderBy("day").rowsBetween(-(rows - 1), 0)
    n, mean, std = F.count("n_docs").over(w), F.avg("n_docs").over(w), F.stddev_samp("n_docs").over(w)
    d = daily.withColumns({"_n": n, "_m": mean, "_s": std})
    score = F.when((F.col("_n") >= least) & (F.col("_s") > 0), (F.col("n_docs") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    out = d.select(*keys, "day", "n_docs", F.round(score, 6).alias("z"), F.when(F.col("_n") >= least, F.round("_m", 1)).alias("expected"))
    return out.withColumn("flag", F.abs("z") > z)


def global_zscore(daily: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys)
    s = F.stddev_samp("n_docs").over(w)
    return daily.withColumn("z", F.round(F.when(s > 0, (F.col("n_docs") - F.avg("n_docs").over(w)) / s).otherwise(0.0), 6))


def month_spine(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def month_gaps(present: DataFrame, start: str, end: str) -> DataFrame:
    return month_spine(present.sparkSession, start, end).join(present.select("month").distinct(), "month", "left_anti")


def zero_filled(series: DataFrame, keys: list[str], x: str, start: str, end: str) -> DataFrame:
    spine = month_spine(series.sparkSession, start, end)
    every = series.select(*keys).distinct().crossJoin(F.broadcast(spine))  # months between two dates
    return every.join(series, [*keys, "month"], "left").select(*keys, "month", F.coalesce(x, F.lit(0)).cast("double").alias("y"))


def rolling_mean(series: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("month").rowsBetween(-(k - 1), 0)
    return series.withColumn("mean", F.round(F.avg("y").over(w), 6))


def changepoint_scan(series: DataFrame, keys: list[str], min_seg: int = 3) -> DataFrame:
    """One level of segmentation: pooled two-sample z of every split point from prefix sums; the best of each series, the earliest on ties."""
    w = W.partitionBy(*keys).orderBy("month")
    left, right = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing)
    d = series.withColumns({"n1": F.count("y").over(left), "m1": F.avg("y").over(left), "v1": F.var_pop("y").over(left) * F.count("y").over(left), "n2": F.count("y").over(right), "m2": F.avg("y").over(right), "v2": F.var_pop("y").over(right) * F.count("y").over(right)})
    d = d.where((F.col("n1") >= min_seg) & (F.col("n2") >= min_seg))
    sp = F.sqrt((F.col("v1") + F.col("v2")) / F.greatest(F.col("n1") + F.col("n2") - 2, F.lit(1)))
    d = d.withColumn("z", F.when(sp > 1e-9, F.round(F.abs(F.col("m1") - F.col("m2")) / (sp * F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))), 6))).where("z IS NOT NULL")
    best = d.groupBy(*keys).agg(F.min(F.struct((-F.col("z")).alias("z"), "month", "m1", "m2")).alias("b"))
    return best.select(*keys, F.col("b.month").alias("cp_month"), (-F.col("b.z")).alias("z"), F.round("b.m1", 6).alias("pre_mean"), F.round("b.m2", 6).alias("post_mean"))


def binseg(y: list[float], min_seg: int = 3, most: int = 3, least_z: float = 2.5) -> list[tuple[int, float, float, float]]:
    """(index, mean before, mean after, z) of up to `most` changepoints of one short series, by binary segmentation; the means are those of the segment that was cut. Of equal z the segment made first
    is cut, at its earliest point."""
    import numpy as np

    def best_of(a: int, b: int) -> tuple[float, int]:
        top = (0.0, -1)
        for t in range(a + min_seg, b - min_seg + 1):
            x1, x2 = np.array(y[a:t]), np.array(y[t:b])
            pooled = (((x1 - x1.mean()) ** 2).sum() + ((x2 - x2.mean()) ** 2).sum()) / max(len(x1) + len(x2) - 2, 1)
            if pooled > 1e-12:
                z = round(abs(x1.mean() - x2.mean()) / (pooled * (1 / len(x1) + 1 / len(x2))) ** 0.5, 9)
                top = max(top, (z, -t), key=lambda p: p[0])
        return top[0], -top[1]

    found, segments = [], [(0, len(y))]
    while len(found) < most:
        (z, t), (a, b) = max(((best_of(a, b), (a, b)) for a, b in segments), key=lambda p: p[0][0])
        if z < least_z:
            break
        found.append((t, float(np.mean(y[a:t])), float(np.mean(y[t:b])), z))
        segments.remove((a, b))
        segments += [(a, t), (t, b)]
    return sorted(found)


def changepoints(series: DataFrame, keys: list[str], least_total: float = 50.0, min_seg: int = 3, most: int = 3, least_z: float = 2.5) -> DataFrame:
    """Binary segmentation of each month series (keys, month, y) whose sum reaches least_total, all series together, one cut of each a round. Every row's split is judged from prefix sums inside its
    segment, and the best of a series is found by window, so one shuffle by the keys serves all rounds."""
    d = series.withColumn("_all", F.sum("y").over(W.partitionBy(*keys))).where(F.col("_all") >= least_total).select(*keys, "month", "y", F.lit(0).alias("_seg"), *[F.lit(None).cast("double").alias(c) for c in ("_pre", "_post", "_z")])
    for r in range(most):
        inside = W.partitionBy(*keys, "_seg")
        before = inside.orderBy("month").rowsBetween(W.unboundedPreceding, -1)
        over = lambda f, w: f("y").over(w)
        square = lambda w: F.sum(F.col("y") * F.col("y")).over(w)
        d = d.withColumns({"n1": over(F.count, before), "s1": over(F.sum, before), "q1": square(before), "n": over(F.count, inside), "s": over(F.sum, inside), "q": square(inside)})
        d = d.withColumns({"n2": F.col("n") - F.col("n1"), "s2": F.col("s") - F.col("s1"), "q2": F.col("q") - F.col("q1")})
        pooled = (F.col("q1") - F.col("s1") * F.col("s1") / F.col("n1") + F.col("q2") - F.col("s2") * F.col("s2") / F.col("n2")) / F.greatest(F.col("n") - 2, F.lit(1))
        d = d.withColumns({"m1": F.try_divide("s1", "n1"), "m2": F.try_divide("s2", "n2"), "p": F.when((F.col("n1") >= min_seg) & (F.col("n2") >= min_seg), pooled)})
        z = F.round(F.abs(F.col("m1") - F.col("m2")) / F.sqrt(F.col("p") * (1 / F.col("n1") + 1 / F.col("n2"))), 9)
        d = d.withColumn("z", F.when(F.col("p") > 1e-12, z))
        best = F.max(F.when(F.col("z") >= least_z, F.struct("z", (-F.col("_seg")).alias("seg"), (-F.unix_date("month")).alias("t")))).over(W.partitionBy(*keys))
        d = d.withColumn("best", best)
        here = F.col("best").isNotNull() & (F.col("_seg") == -F.col("best.seg"))
        cut = here & (F.unix_date("month") == -F.col("best.t"))
        keep = lambda old, new: F.when(cut, F.col(new)).otherwise(F.col(old)).alias(old)  # noqa: B023, E731
        d = d.select(*keys, "month", "y", F.when(here, F.when(F.unix_date("month") >= -F.col("best.t"), 2 * r + 2).otherwise(2 * r + 1)).otherwise(F.col("_seg")).alias("_seg"), keep("_pre", "m1"), keep("_post", "m2"), keep("_z", "z"))
    change = F.when(F.col("_pre") > 0, F.round(F.col("_post") / F.col("_pre"), 2))
    return d.where("_z IS NOT NULL").select(*keys, F.col("month").alias("cp_month"), F.round("_pre", 1).alias("pre_mean"), F.round("_post", 1).alias("post_mean"), F.when(F.col("_post") > F.col("_pre"), "surge").otherwise("decline").alias("direction"), change.alias("magnitude"), F.round("_z", 2).alias("z"))


def prior_period(start: str, end: str):
    """Columns (start, end) of the window of equal length before [start, end]."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    prior_end = F.date_sub(s, 1)
    return F.date_sub(prior_end, F.greatest(F.datediff(e, s), F.lit(1))), prior_end


def category_spike(base: DataFrame, start: str, end: str, least: int = 5, rise: float = 0.5) -> DataFrame:
    """Categories up by at least half against the window before, both windows in one scan."""
    s0, e0 = prior_period(start, end)
    inside = lambda a, b: F.count_distinct(F.when(F.col("date").between(a, b), F.col("doc_id")))
    g = base.groupBy("category").agg(inside(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("current"), inside(s0, e0).alias("prior"))
    g = g.withColumn("change", F.round((F.col("current") - F.col("prior")) / F.greatest(F.col("prior").cast("double"), F.lit(0.5)), 6))
    return g.where((F.col("current") >= least) & (F.col("change") >= rise))


def materiality_outliers(ce: DataFrame, z: float = 1.5, k: int = 6) -> DataFrame:
    s = F.col("material_score").cast("double")
    stats = ce.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"))
    j = ce.where("material_score IS NOT NULL").crossJoin(F.broadcast(stats)).where("n >= 5 AND std > 0")  # one row
    j = j.withColumn("z", F.round((s - F.col("mean")) / F.col("std"), 6)).where(F.col("z") >= z)
    return j.orderBy(F.desc("z"), "id").limit(k).select("id", "z")


def trajectory(current: DataFrame, prior: DataFrame) -> DataFrame:
    """One row each of n_docs, n_events, n_articles, mean_score -> changes, votes, verdict and confidence. A mean score that only one period has is a vote of one; a signal is available if either period
    has it. Under five documents before, the verdict is steady and the confidence low."""
    j = current.crossJoin(F.broadcast(prior.select(*[F.col(c).alias(f"p_{c}") for c in prior.columns])))  # one row

    def change(c: str):
        return (F.col(c) - F.col(f"p_{c}")) / F.greatest(F.col(f"p_{c}").cast("double"), F.lit(1.0))

    def vote(x, a: float, b: float):
        return F.when(x >= b, 2).when(x >= a, 1).when(x <= -b, -2).when(x <= -a, -1).otherwise(0)

    now, before = F.col("mean_score"), F.col("p_mean_score")
    score = now - before
    by_score = F.when(now.isNull() & before.isNull(), 0).when(now.isNull(), -1).when(before.isNull(), 1).otherwise(vote(score, 0.5, 1.5))
    counts = ("n_docs", "n_events", "n_articles")
    total = sum((vote(change(c), 0.2, 0.5) for c in counts), by_score)
    available = sum((((F.col(c) > 0) | (F.col(f"p_{c}") > 0)).cast("int") for c in counts), (now.isNotNull() | before.isNotNull()).cast("int"))
    thin = F.col("p_n_docs") < 5
    verdict = F.when(thin, "steady").when(total >= 2, "accelerating").when(total <= -2, "cooling").otherwise("steady")
    sure = F.when(thin, "LOW").when((available >= 3) & (F.abs(total) >= 5), "HIGH").when((available >= 2) & (F.abs(total) >= 2), "MED").otherwise("LOW")
    return j.select(
        *[F.round(change(c), 6).alias(f"{c[2:]}_delta") for c in counts],
        F.round(score, 6).alias("score_delta"),
        F.when(thin, 0).otherwise(total).cast("int").alias("votes"),
        verdict.alias("trajectory"),
        sure.alias("confidence"),
    )


def rank_in_cohort(counts: DataFrame, name: str, x: str) -> DataFrame:
    """Rank (1 is the largest), share strictly below in percent, and the distance to the cohort's median and mean."""
    stats = counts.agg(F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.count("*").alias("n"))
    below = F.rank().over(W.orderBy(x)) - 1
    r = counts.withColumns({"rank": F.row_number().over(W.orderBy(F.desc(x), name)), "below": below})
    return r.crossJoin(F.broadcast(stats)).select(name, x, "rank", F.round(100.0 * F.col("below") / F.col("n"), 6).alias("percentile"), "median", F.round("mean", 6).alias("mean"), F.round((F.col(x) - F.col("median")) / F.nullif("median", F.lit(0.0)), 6).alias("vs_median"))


def alert_surge(daily: DataFrame, x: str, as_of: str, days: int = 30, z: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """z of the newest day against the days before it in the window, by population deviation; none under five days or without deviation."""
    keys = keys or []
    end = F.lit(as_of).cast("date")
    d = daily.where((F.col("day") <= end) & (F.col("day") > F.date_sub(end, days)))
    w = W.partitionBy(*keys).orderBy(F.desc("day"))
    r = d.withColumn("r", F.row_number().over(w))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("r") == 1, F.col(x))).alias("latest"), F.avg(F.when(F.col("r") > 1, F.col(x))).alias("mean"), F.stddev_pop(F.when(F.col("r") > 1, F.col(x))).alias("std"))
    g = g.where((F.col("n") >= 5) & (F.col("std") > 0)).withColumn("z", F.round((F.col("latest") - F.col("mean")) / F.col("std"), 6))
    return g.where(F.col("z") >= z).select(*keys, "latest", F.round("mean", 6).alias("mean"), "z")


def alert_new(rows: DataFrame, since: str, name: str, created: str) -> DataFrame:
    """How many rows are newer than the last evaluation, and their first ten names."""
    new = rows.where(F.col(created) > F.lit(since).cast("date"))
    return new.agg(F.count("*").alias("n")).crossJoin(new.select(name).orderBy(name).limit(10).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names")))


def alert_cooldown(firings: DataFrame, minutes: int) -> DataFrame:
    """Firings (rule_id, at) that are not within `minutes` of the last one let through; sequential within a rule. Rules are streamed in order of time, and only the time last let through is
    held. Firings of a null rule are one rule; one without a time is let through only if it is all that its rule has."""
    least = 60_000_000 * minutes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, last, begun = None, None, False
        for b in batches:
            keep = []
            for r, t in zip(b.column("rule_id").to_pylist(), b.column("at").cast(pa.timestamp("us", b.schema.field("at").type.tz)).cast(pa.int64()).to_pylist(), strict=True):
                if not begun or r != rule:
                    rule, begun, ok = r, True, True
                else:
                    ok = t is not None and last is not None and t - last >= least
                keep.append(ok)
                last = t if ok else last
            yield b.filter(pa.array(keep, pa.bool_()))

    return firings.repartition("rule_id").sortWithinPartitions(F.col("rule_id"), F.asc_nulls_last("at")).mapInArrow(run, firings.schema)


def data_sufficiency(n_docs, n_events):
    """Confidence by documents and events: 200/10 high, 50/5 medium, 20/3 low, else insufficient."""
    at_least = lambda d, e: (n_docs >= d) & (n_events >= e)
    return F.when(at_least(200, 10), "HIGH").when(at_least(50, 5), "MEDIUM").when(at_least(20, 3), "LOW").otherwise("INSUFFICIENT")


def split_blocks(days: list, vectors: list | None = None, drift: float | None = None, gap: int = 30, least: int = 3, most_span: int = 180, window: int = 90) -> list[int]:
    """Block number of each sorted day. A block begins at a gap, or, once `least` rows are in the one before, where the row's vector is nearer than `drift` to the block's running centroid no longer.
    Then blocks under `least` rows join the one before (the first joins the next), and long ones are cut into windows from each window's first day."""
    import numpy as np

    blocks: list[list[int]] = []
    centroid = None
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-9)
    rows = [unit(np.asarray(v, float)) for v in vectors] if vectors is not None and drift is not None else None
    for i, d in enumerate(days):
        away = rows is not None and i > 0 and len(blocks[-1]) >= least and float(rows[i] @ centroid) < drift
        if i == 0 or (d - days[i - 1]).days >= gap or away:
            blocks.append([i])
            centroid = rows[i] if rows is not None else None
        else:
            blocks[-1].append(i)
            if rows is not None:
                n = len(blocks[-1])
                centroid = unit((centroid * (n - 1) + rows[i]) / n)
    merged: list[list[int]] = blocks[:1]
    for b in blocks[1:]:
        if len(b) < least:
            merged[-1] = merged[-1] + b
        else:
            merged.append(b)
    if len(merged) > 1 and len(merged[0]) < least:
        merged[:2] = [merged[0] + merged[1]]
    out, k = [0] * len(days), -1
    for b in merged:
        k, anchor = k + 1, days[b[0]]
        cut = (days[b[-1]] - days[b[0]]).days > most_span
        for i in b:
            if cut and (days[i] - anchor).days >= window:
                k, anchor = k + 1, days[i]
            out[i] = k
    return out


def split_by_gap(dem: DataFrame, gap: int = 30, least: int = 3, most_span: int = 180, window: int = 90) -> DataFrame:
    """Block of each (event, day), by the rules of split_blocks without vectors, in one shuffle by the event: gaps and short blocks by windows, long blocks by a fold over their days. Rows of one day are in one
    block; a row without a day has none and is left out."""
    e, day = "canonical_event_id", "mention_date"
    event = W.partitionBy(e)
    d = dem.where(F.col(day).isNotNull()).select(e, F.col(day).cast("date").alias(day))
    apart = F.coalesce(F.datediff(day, F.lag(day).over(event.orderBy(day))) >= gap, F.lit(False))
    d = d.withColumn("_apart", apart.cast("int")).withColumn("_b", F.sum("_apart").over(event.orderBy(day)))
    d = d.withColumn("_n", F.count("*").over(W.partitionBy(e, "_b")))
    # a short block takes the number of the last one before it that is not; the first counts as such
    d = d.withColumn("_b", F.max(F.when((F.col("_n") >= least) | (F.col("_b") == 0), F.col("_b"))).over(event.orderBy(day)))
    d = d.withColumn("_n", F.count("*").over(W.partitionBy(e, "_b"))).withColumn("_next", F.min(F.when(F.col("_b") > 0, F.col("_b"))).over(event))
    d = d.withColumn("_b", F.when((F.col("_b") == 0) & (F.col("_n") < least), F.coalesce("_next", "_b")).otherwise(F.col("_b")))
    held = d.groupBy(e, "_b").agg(F.array_sort(F.collect_list(day)).alias("_days"))
    starts = F.aggregate("_days", F.slice("_days", 1, 1), lambda a, x: F.when(F.datediff(x, F.element_at(a, -1)) >= window, F.concat(a, F.array(x))).otherwise(a))
    held = held.withColumn("_starts", F.when(F.datediff(F.element_at("_days", -1), F.element_at("_days", 1)) > most_span, starts).otherwise(F.slice("_days", 1, 1)))
    rows = held.select(e, "_b", "_starts", F.explode("_days").alias(day)).withColumn("_w", F.size(F.filter("_starts", lambda x: x <= F.col(day))))
    return rows.select(e, day, (F.dense_rank().over(event.orderBy("_b", "_w")) - 1).alias("block"))


def split_by_drift(dem: DataFrame, vectors: str, drift: float, gap: int = 30) -> DataFrame:
    """Block of each (event, day) by gap and by drift from a block's running centroid, which only a walk over the days can tell. An event's days are one short group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mention_date").reset_index(drop=True)
        days = [pd.Timestamp(d) for d in pdf["mention_date"]]
        return pdf[["canonical_event_id", "mention_date"]].assign(block=split_blocks(days, list(pdf[vectors]), drift, gap))

    return dem.select("canonical_event_id", "mention_date", vectors).groupBy("canonical_event_id").applyInPandas(run, f"canonical_event_id {dem.schema['canonical_event_id'].dataType.simpleString()}, mention_date date, block int")


def binseg_udtf(spark):
    """Register `binseg(months, values)` as a table function, so that SQL can join changepoints laterally: cp_month, pre_mean, post_mean, z of one series."""
    from pyspark.sql.functions import udtf

    class Binseg:
        def eval(self, months: list, values: list):
            order = sorted(range(len(months or [])), key=lambda i: months[i])
            for t, pre, post, z in binseg([float(values[i]) for i in order]):
                yield months[order[t]], round(pre, 1), round(post, 1), round(float(z), 2)

    made = udtf(Binseg, returnType="cp_month date, pre_mean double, post_mean double, z double")
    spark.udtf.register("binseg", made)
    return made
