"""Runs of equal tier as intervals, and the questions asked of them.

Run-length encoding is gaps-and-islands over windows partitioned by recording: one shuffle feeds all of its window
functions and the aggregate, as every key begins with the recording.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrays import prediction_set

POOR, USABLE = ("Q0", "Q1"), ("Q2", "Q3")
ROLES = {"all": ("Q0", "Q1", "Q2", "Q3"), "q0": ("Q0",), "poor": POOR, "usable": USABLE}


def rank(tier: Column) -> Column:
    return F.substring(tier, 2, 1).cast("int")


def with_runs(windows: DataFrame, key: str = "rec", order: str = "start_n", value: Sequence[str] = ("tier",)) -> DataFrame:
    """`windows` with `run`: the number of the run of equal values, from 0."""
    w = W.partitionBy(key).orderBy(order)
    same = F.lit(True)
    for v in value:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    first = F.lag(order).over(w).isNull()
    rows = windows.withColumn("_new", F.when(~first & same, 0).otherwise(1))
    return rows.withColumn("run", (F.sum("_new").over(w) - 1).cast("long")).drop("_new")


def run_length_encode(windows: DataFrame, length: float, start: str = "start_n") -> DataFrame:
    """Intervals (rec, run, start_sec, end_sec, tier, confidence, uncertainty, n_windows) from graded windows.

    Two runs that overlap meet in the middle of the stretch that both cover; runs that do not overlap keep their edges;
    the outer edges of a recording are those of its first and last window.
    """
    rows = with_runs(windows, order=start)
    runs = rows.groupBy("rec", "run").agg(
        F.min(start).alias("first"), F.max(start).alias("last"), F.first("tier").alias("tier"), F.avg("confidence").alias("confidence"),
        F.avg("uncertainty").alias("uncertainty"), F.count("*").alias("n_windows"),
    )
    return bounded(runs, length)


def bounded(runs: DataFrame, length: float) -> DataFrame:
    """Runs (rec, run, first, last: starts of their outer windows) with start_sec and end_sec."""
    w = W.partitionBy("rec").orderBy("run")
    before, after = F.lag("last").over(w) + length, F.lead("first").over(w)
    first, last = F.col("first").cast("double"), F.col("last") + F.lit(float(length))
    start = F.when(before.isNull() | (first >= before), first).otherwise((first + before) / 2)
    end = F.when(after.isNull() | (after >= last), last).otherwise((after + last) / 2)
    return runs.withColumn("start_sec", start).withColumn("end_sec", end).drop("first", "last")


def artifact_union(windows: DataFrame, column: str = "artifacts", start: str = "start_n") -> DataFrame:
    """(rec, run, artifacts): tags of each run in the order in which they are first seen."""
    tags = F.array_sort(F.collect_list(F.struct(F.col(start).alias("at"), F.col(column).alias("tags"))))
    rows = with_runs(windows, order=start).groupBy("rec", "run").agg(tags.alias("t"))
    return rows.select("rec", "run", F.array_distinct(F.flatten(F.transform("t", lambda s: s["tags"]))).alias(column))


def majority(windows: DataFrame, flag: str, value: str, start: str = "start_n") -> DataFrame:
    """(rec, run, flag, value): flag if half of the run's windows have it; the commonest value among those, ties by code point."""
    rows = with_runs(windows, order=start)
    counts = rows.groupBy("rec", "run", value).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).alias("yes"))
    best = F.min(F.when((F.col("yes") > 0) & (F.col(value) != ""), F.struct(F.negate("yes").alias("no"), F.col(value).alias("v"))))
    out = counts.groupBy("rec", "run").agg((F.sum("yes") * 2 >= F.sum("n")).alias(flag), best.alias("best"))
    return out.select("rec", "run", flag, F.when(F.col(flag), F.coalesce(F.col("best.v"), F.lit(""))).otherwise("").alias(value))


def run_figures(windows: DataFrame, length: float, threshold: float | None = None, start: str = "start_n") -> DataFrame:
    """The intervals of `run_length_encode` with all that a run carries, from windows with artifacts, recoverable,
    recovered_tier, rate_usable, hr_bpm and probs, in the same aggregation: tags in the order in which they are first
    seen; a flag if half of the windows have it; with it the commonest recovered tier, the first of equals, and the median
    rate of usable windows; the prediction set of the mean probabilities, empty without a threshold."""
    rows = with_runs(windows, order=start)
    half = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")) >= 0.5
    tier = F.when(F.col("recoverable") & (F.col("recovered_tier") != ""), F.col("recovered_tier"))
    rate = F.when(F.col("rate_usable") & (F.col("hr_bpm") > 0), F.col("hr_bpm"))
    runs = rows.groupBy("rec", "run").agg(
        F.min(start).alias("first"), F.max(start).alias("last"), F.first("tier").alias("tier"), F.avg("confidence").alias("confidence"),
        F.avg("uncertainty").alias("uncertainty"), F.count("*").alias("n_windows"), half("recoverable").alias("recoverable"), F.mode(tier, True).alias("_tier"),
        half("rate_usable").alias("rate_usable"), F.percentile(rate, F.lit(0.5)).alias("_rate"), F.array(*(F.avg(F.col("probs")[k]) for k in range(len(ROLES["all"])))).alias("_p"),
        F.array_sort(F.collect_list(F.struct(F.col(start).alias("at"), F.col("artifacts").alias("tags")))).alias("_tags"),
    )
    members = F.array().cast("array<string>") if threshold is None else prediction_set(F.col("_p"), list(ROLES["all"]), threshold)
    runs = runs.withColumn("recovered_tier", F.when(F.col("recoverable"), F.coalesce("_tier", F.lit(""))).otherwise(""))
    runs = runs.withColumn("hr_bpm", F.when(F.col("rate_usable"), F.coalesce("_rate", F.lit(0.0))).otherwise(0.0)).withColumn("conformal_set", members)
    runs = runs.withColumn("artifacts", F.array_distinct(F.flatten(F.transform("_tags", lambda t: t["tags"]))))
    return bounded(runs.drop("_tier", "_rate", "_p", "_tags"), length)


def window_intervals(windows: DataFrame, length: float, start: str = "start_n") -> DataFrame:
    """One interval per window; they overlap."""
    return windows.withColumn("start_sec", F.col(start).cast("double")).withColumn("end_sec", F.col(start) + F.lit(float(length)))


def filter_intervals(intervals: DataFrame, role: str) -> DataFrame:
    """Intervals of a role: all, q0, poor, usable or recoverable."""
    if role == "recoverable":
        return intervals.filter("recoverable")
    if role not in ROLES:
        raise ValueError(f"unknown role {role}")
    return intervals.filter(F.col("tier").isin(*ROLES[role]))


def next_after(intervals: DataFrame, t: float, tiers: Sequence[str] = POOR) -> DataFrame:
    """The earliest interval of each recording that starts after t with one of the tiers."""
    rows = intervals.filter((F.col("start_sec") > t) & F.col("tier").isin(*tiers))
    names = [c for c in rows.columns if c != "rec"]
    found = rows.groupBy("rec").agg(F.min_by(F.struct(*names), F.struct("start_sec", "run")).alias("i"))
    return found.select("rec", "i.*")


def segment_at(intervals: DataFrame, t: float) -> DataFrame:
    return intervals.filter((F.col("start_sec") <= t) & (F.col("end_sec") > t))


def segments_in_range(intervals: DataFrame, start: float, end: float) -> DataFrame:
    return intervals.filter((F.col("start_sec") < end) & (F.col("end_sec") > start))


def tier_fractions(intervals: DataFrame) -> DataFrame:
    """(rec, tier, fraction): share of the duration; tiers that do not occur are left out."""
    sums = intervals.groupBy("rec", "tier").agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("d"))
    return sums.select("rec", "tier", (F.col("d") / F.sum("d").over(W.partitionBy("rec"))).alias("fraction"))


def shares(intervals: DataFrame) -> DataFrame:
    """(rec, usable, flagged): shares of the duration in Q2 and Q3, and in Q0."""
    d = F.col("end_sec") - F.col("start_sec")
    of = lambda tiers: F.sum(F.when(F.col("tier").isin(*tiers), d).otherwise(0.0)) / F.sum(d)
    return intervals.groupBy("rec").agg(of(USABLE).alias("usable"), of(("Q0",)).alias("flagged"))


def artifact_bars(intervals: DataFrame) -> DataFrame:
    return intervals.select(F.explode("artifacts").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def segment_bands(intervals: DataFrame) -> DataFrame:
    """(rec, run, tier, at, width) as shares of the recording's end."""
    end = F.max("end_sec").over(W.partitionBy("rec"))
    return intervals.select("rec", "run", "tier", (F.col("start_sec") / end).alias("at"), ((F.col("end_sec") - F.col("start_sec")) / end).alias("width"))


def recoverable_share(intervals: DataFrame) -> DataFrame:
    """(rec, n, fraction): recoverable intervals, and their duration over that of the poor ones, at most 1."""
    d = F.col("end_sec") - F.col("start_sec")
    poor = F.sum(F.when(F.col("tier").isin(*POOR), d).otherwise(0.0))
    good = F.sum(F.when(F.col("recoverable"), d).otherwise(0.0))
    return intervals.groupBy("rec").agg(F.sum(F.col("recoverable").cast("long")).alias("n"), F.when(poor > 0, F.least(F.lit(1.0), good / poor)).otherwise(0.0).alias("fraction"))


def sustained(samples: DataFrame, flag: str, least: int, key: str = "rec", order: str = "n") -> DataFrame:
    """`samples` with `flag` kept only on runs of at least `least` rows."""
    rows = with_runs(samples, key, order, (flag,))
    size = F.count("*").over(W.partitionBy(key, "run"))
    return rows.withColumn(flag, F.col(flag) & (size >= least)).drop("run")


def overlap_join(intervals: DataFrame, spans: DataFrame, width: float, key: str = "rec") -> DataFrame:
    """Pairs of an interval and a span (lo, hi) of a recording that intersect.

    Both sides are dealt to time bins of `width`, so a long recording is many small equi-joins; a pair counts in the bin
    where its common part begins, so it comes once.
    """
    bins = lambda a, b: F.sequence(F.floor(a / width), F.greatest(F.floor(a / width), F.ceil(b / width) - 1))
    left = intervals.withColumn("_bin", F.explode(bins(F.col("start_sec"), F.col("end_sec"))))
    right = spans.withColumn("_bin", F.explode(bins(F.col("lo"), F.col("hi"))))
    begin = F.floor(F.greatest("start_sec", "lo") / width)
    pairs = left.join(right, [key, "_bin"]).filter((F.col("start_sec") < F.col("hi")) & (F.col("end_sec") > F.col("lo")))
    return pairs.filter(F.col("_bin") == begin).drop("_bin")


def discordant(intervals: DataFrame, column: str = "consensus") -> DataFrame:
    """`intervals` with discordant: the grader finds it usable, and the quality figures, if there are any, do not."""
    return intervals.withColumn("discordant", F.col("tier").isin(*USABLE) & (F.col(column) >= 0) & (F.col(column) < 0.5))


def span_samples(samples: DataFrame, spans: DataFrame, fs: float) -> DataFrame:
    """Samples [start fs, end fs) of the span (start_sec, end_sec) of each recording, one sample at least."""
    lo = F.greatest(F.lit(0), F.floor(F.col("start_sec") * fs))
    bounds = spans.select("rec", lo.alias("_lo"), F.greatest(lo + 1, F.floor(F.col("end_sec") * fs)).alias("_hi"))
    return samples.join(bounds, "rec").filter((F.col("n") >= F.col("_lo")) & (F.col("n") < F.col("_hi"))).select("rec", "n", "x")


def rationale(tier: Column, confidence: Column, seconds: Column, artifacts: Column) -> Column:
    """A line on an interval: grade, confidence, duration and what is wrong."""
    tags = F.when(F.size(artifacts) > 0, F.concat(F.lit("artifacts "), F.array_join(artifacts, ", ")))
    return F.concat_ws(" | ", F.concat(F.lit("grade "), tier), F.format_string("confidence %.2f", confidence), F.format_string("%.1f s", seconds), tags)
